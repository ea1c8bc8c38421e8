"""Metrics and reports of alignments, books and shelves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.kernels import word_block_ratio

LEAST_COVERAGE, SAME_PASSAGE, THIN, LOPSIDED, PER_MINUTE = 0.7, 0.6, 200, 3.0, 390


def coverage(total: Column, unmatched: Column) -> Column:
    return F.when(total > 0, (total - unmatched) / total).otherwise(0.0)


def degraded(total: Column, unmatched: Column) -> Column:
    return (total > 0) & (coverage(total, unmatched) < LEAST_COVERAGE)


def placed_share(placed: DataFrame, published: DataFrame) -> DataFrame:
    """(book, share): characters of the distinct texts placed over all published; NULL without any."""
    a = placed.filter("value <> ''").select("book", "value").distinct().groupBy("book").agg(F.sum(F.length("value")).alias("placed"))
    b = published.groupBy("book").agg(F.sum(F.length("text")).alias("all"))
    return b.join(a, "book", "left").select("book", F.when(F.col("all") > 0, F.coalesce("placed", F.lit(0)) / F.col("all")).alias("share"))


@F.pandas_udf(T.DoubleType())
def passage_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of the shorter passage stands in the other in matching blocks of words."""
    return pd.Series([0.0 if x is None or y is None else word_block_ratio(x, y) for x, y in zip(a, b)])


def agreement(paragraphs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a book: how two placements (h, value) of one translation agree over its paragraphs (book, h)."""
    rows = paragraphs.select("book", "h").join(a.select("h", F.col("value").alias("a")), "h", "left").join(b.select("h", F.col("value").alias("b")), "h", "left")
    rows = rows.na.fill("", ["a", "b"])
    both = (F.col("a") != "") & (F.col("b") != "")
    same = F.when(F.col("a") == F.col("b"), 1.0).otherwise(passage_ratio("a", "b"))
    rows = rows.withColumn("same", F.when(both, same))
    n = rows.groupBy("book").agg(
        F.count("*").alias("total"), F.count_if(F.col("same") >= SAME_PASSAGE).alias("agreed"), F.count_if(F.col("same") < SAME_PASSAGE).alias("disagreed"),
        F.count_if((F.col("a") != "") & (F.col("b") == "")).alias("only_a"), F.count_if((F.col("a") == "") & (F.col("b") != "")).alias("only_b"), F.count_if((F.col("a") == "") & (F.col("b") == "")).alias("neither"),
    )
    judged = F.col("agreed") + F.col("disagreed")
    return n.withColumn("accuracy", F.when(judged > 0, F.col("agreed") / judged))


def spread_fault(left: Column, right: Column) -> Column:
    """What is wrong with a spread of so many characters a side: 'one side', 'empty', 'lopsided' or NULL."""
    thin = (left < THIN).cast("int") + (right < THIN).cast("int")
    return F.when(thin == 1, "one side").when(thin == 2, F.when((left == 0) | (right == 0), "empty").when(F.greatest(left, right) > F.least(left, right) * LOPSIDED, "lopsided")).when(F.greatest(left, right) > F.least(left, right) * LOPSIDED, "lopsided")


def shelf_minutes(paragraphs: Column, others: Column) -> Column:
    return F.greatest(F.lit(1), F.bround((paragraphs + others) / PER_MINUTE).cast("int"))


def shelf_tokens(chars: Column, others: Column) -> Column:
    return F.bround((chars + others) / 4).cast("bigint")


def drift(recorded: DataFrame, measured: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, recorded, measured): where two records differ, a missing one included."""
    a = recorded.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = measured.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    rows = a.join(b, key, "full")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("recorded"), F.col(f"b_{f}").alias("measured")) for f in fields])
    return rows.select(key, F.explode(F.filter(pairs, lambda p: ~p["recorded"].eqNullSafe(p["measured"]))).alias("p")).select(key, "p.*")


def useful_facets(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, n): filters that keep some rows but not all."""
    flags = F.array(*[F.struct(F.lit(k).alias("facet"), c.alias("hit")) for k, c in facets.items()])
    n = rows.select(F.explode(flags).alias("f")).groupBy("f.facet").agg(F.count_if("f.hit").alias("n"), F.count("*").alias("all"))
    return n.filter("n > 0 and n < all").select("facet", "n")


def retry_share(retry: Column, cost: Column) -> Column:
    return F.when(cost > retry, retry / (cost - retry))
