"""Greedy packing in reading order, and other walks over one ordered array.

The accumulator of a greedy packer starts again at a place that depends on the data, so a
running sum is not the same; all packers share one fold over the ordered array of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_groups(sizes: Column, most_size: int, most_count: int = 2_000_000_000, gap: int = 0) -> Column:
    """The group number of each element of ``sizes``: a group takes elements while their sum
    (with ``gap`` between two) is within ``most_size`` and their number within ``most_count``;
    an element over the size stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("g"), F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] == 0) | (a["s"] + gap + x > most_size) | (a["n"] >= most_count)
        g = a["g"] + F.when(new, 1).otherwise(0)
        return F.struct(F.concat(a["out"], F.array(g)).alias("out"), g.alias("g"), F.when(new, x.cast("bigint")).otherwise(a["s"] + gap + x).alias("s"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def pack_rows(rows: DataFrame, book: str, order: list[str], size: Column, most_size: int, most_count: int = 2_000_000_000, gap: int = 0) -> DataFrame:
    """(book, *order, group): rows of each book packed greedily in order."""
    per = rows.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(*order, size.cast("int").alias("size_")))).alias("a"))
    per = per.select(book, "a", greedy_groups(F.col("a.size_"), most_size, most_count, gap).alias("g"))
    return per.select(book, F.explode(F.arrays_zip("a", "g")).alias("z")).select(book, *[F.col("z.a")[c].alias(c) for c in order], F.col("z.g").alias("group"))


def opening(rows: DataFrame, book: str, order: list[str], size: Column, most: int = 40_000, least_rows: int = 40, most_rows: int = 400) -> DataFrame:
    """(book, total, opening): how many paragraphs open a book: those with fewer than ``most``
    characters before them, within bounds and not more than there are."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(book).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = rows.withColumn("before", before).groupBy(book).agg(F.count("*").alias("total"), F.count_if(F.col("before") < most).alias("n"))
    return counted.select(book, "total", F.least("total", F.greatest(F.lit(least_rows), F.least(F.lit(most_rows), "n"))).alias("opening"))
