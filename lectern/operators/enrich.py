"""Costly enrichment: keyed caches, what is still to do, the client surface, the cost cap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE_VERSION = 1
CACHE = "key string, value string, version int, written_at timestamp"
#: Texts a call to an embedding service.
EMBED_BATCH = 64


class CacheVersionError(ValueError):
    """The cache was written under another schema version."""


def load_cache(spark: SparkSession, path: str, version: int = CACHE_VERSION) -> DataFrame:
    """A written cache; a missing one is empty, one of another version an error."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CACHE)
        raise
    other = held.filter(F.col("version") != version).select("version").limit(1).collect()
    if other:
        raise CacheVersionError(f"cache version {other[0].version}, wanted {version}")
    return held


def merge_caches(disk: DataFrame, mine: DataFrame) -> DataFrame:
    """Disk and own entries as one; the own entry wins a key both hold."""
    both = disk.withColumn("own", F.lit(0)).unionByName(mine.withColumn("own", F.lit(1)))
    rest = [c for c in disk.columns if c != "key"]
    best = F.max_by(F.struct(*rest), F.struct("own", *[c for c in ("written_at", "value") if c in rest])).alias("b")
    return both.groupBy("key").agg(best).select("key", "b.*")


def to_do(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted rows (key, text) not in the cache, once a key (the least text of several)."""
    return wanted.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))


def call_batches(rows: DataFrame, complete: Callable[[list[str]], list[str]], batch: int = EMBED_BATCH, attempts: int = 2) -> DataFrame:
    """(key, value): a client called on batches of texts inside each partition.

    A call that fails or gives another number of answers is tried again; then its rows are
    left out, to be found by the next anti-join. Blank texts are sent as one space.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch]
                for _ in range(attempts):
                    try:
                        answers = complete([t if t and t.strip() else " " for t in some["text"]])
                    except Exception:  # noqa: BLE001, S112  the client's failures are rows still to do
                        continue
                    if len(answers) == len(some):
                        done.extend(zip(some["key"], answers))
                        break
            yield pd.DataFrame(done, columns=["key", "value"])

    return rows.select("key", "text").mapInPandas(run, "key string, value string")


def translate_in_order(units: DataFrame, complete: Callable[[str, str, str], str]) -> DataFrame:
    """(book, pos, value): translations where each call sees the paragraph before and its translation.

    The dependency is sequential, so a chapter (book, chapter) is one group and chapters run beside each other.
    """

    def run(chapter: pd.DataFrame) -> pd.DataFrame:
        chapter = chapter.sort_values("pos")
        before = value = ""
        out = []
        for text in chapter["text"]:
            value = complete(text, before, value)
            before = text
            out.append(value)
        return pd.DataFrame({"book": chapter["book"].tolist(), "pos": chapter["pos"].tolist(), "value": out})

    schema = f"book {units.schema['book'].dataType.simpleString()}, pos bigint, value string"
    return units.select("book", "chapter", F.col("pos").cast("bigint").alias("pos"), "text").groupBy("book", "chapter").applyInPandas(run, schema)


def until_cap(batches: DataFrame, cap: float, book: str = "book") -> DataFrame:
    """Batches (book, batch, cost) up to the first that reaches the cap, that one included."""
    before = F.coalesce(F.sum("cost").over(Window.partitionBy(book).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return batches.withColumn("before", before).filter(F.col("before") < cap).drop("before")


def price_key(model: Column) -> Column:
    """A model's name as its price list has it: the last path part, dashes for dots."""
    return F.replace(F.element_at(F.split(model, "/"), -1), F.lit("."), F.lit("-"))


def estimate(batches: DataFrame, prompt_chars: int, chars_per_token: int = 4, growth: float = 1.15) -> DataFrame:
    """(book, batches, input_tokens, output_tokens) of batches (book, batch, chars, context): the
    prompt goes out once a batch, with the paragraph before it."""
    n = batches.groupBy("book").agg(F.count("*").alias("batches"), F.sum("chars").alias("chars"), F.sum("context").alias("context"))
    out = F.ceil(F.col("chars") * F.lit(growth)) if growth < 2 else F.floor(F.col("chars") * F.lit(growth))
    return n.select("book", "batches", F.floor((F.col("batches") * prompt_chars + F.col("chars") + F.col("context")) / chars_per_token).alias("input_tokens"), F.floor(out / chars_per_token).alias("output_tokens"))
