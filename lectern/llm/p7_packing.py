"""Filling fixed-capacity containers with items.

Method: minimum bin slack. Texts of one token length are interchangeable, so the plan is made
on the histogram of lengths, which has at most ``capacity`` entries whatever the corpus: the
longest length left opens a container, a bit-set subset-sum over the lengths left (with their
counts) finds the fill closest to capacity, the counts are read back from the sums, and the
pattern is used as often as its lengths last. Texts then take their places by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.p9_split import split_text
from lectern.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from lectern.session import small, table, written

CAPACITY = 2048
#: Rows of one length and salt that one task ranks, about.
RANKED_ROWS = 100_000

SIZES = "doc_id bigint, piece int, start bigint, end bigint, n_tokens int"


def best_fill(room: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each length make the greatest sum within ``room``.

    Bit s of a set says that the sum s can be made; a length's count enters in powers of two.
    An exact fill stops the search. The sums are read back from the last set to the first.
    """
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length, count in zip(lengths, counts):
        left = min(count, room // length) if length <= room else 0
        unit = 1
        while left:
            k = min(unit, left)
            steps.append((length, k, reach))
            reach = (reach | (reach << (length * k))) & mask
            left -= k
            unit *= 2
        if reach & full:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by length, containers) of each pattern, until no length is left."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be within 1 and the capacity")
    out = []
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        left[top] -= 1
        fill = best_fill(capacity - top, order, [left[n] for n in order])
        left[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(left[n] // k for n, k in fill.items())
        for n, k in fill.items():
            left[n] -= k * times
        out.append((fill, times))
        order = [n for n in order if left[n]]
    return out


def item_sizes(documents: DataFrame, capacity: int, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, end, n_tokens): each document, split only where it exceeds the capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SIZES.split(", ")]
        for batch in batches:
            rows = []
            for ident, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    rows.append((ident, 0, 0, 0, 0))
                    continue
                n = token_count(text, folder, name) if len(text) < 16 * capacity else capacity + 1
                if n <= capacity:
                    rows.append((ident, 0, 0, len(text), n))
                else:
                    rows.extend((ident, k, a, e, z) for k, (a, _, e, z) in enumerate(split_text(text, capacity, 0, folder, name)))
            yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "text").mapInPandas(run, SIZES)


def pack(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, piece, start, end, n_tokens): every row of ``documents`` in a container.

    Containers hold at most ``capacity`` tokens. NULL and empty texts have no tokens and stand
    in none (bin_id NULL). Repeated rows are items of their own. A length that a third of all
    rows share is ranked in salted parts.
    """
    items = written(item_sizes(documents, capacity, folder, name), "sizes")
    histogram = {r.n_tokens: r["count"] for r in items.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    spans: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for fill, times in plan(histogram, capacity):
        for n, k in fill.items():
            spans.setdefault(n, []).append((taken.get(n, 0), base, k))
            taken[n] = taken.get(n, 0) + k * times
        base += times
    places = documents.sparkSession.sparkContext.broadcast({n: tuple(np.array(x, dtype=np.int64) for x in zip(*s)) for n, s in spans.items()})

    @F.pandas_udf(T.LongType())
    def bin_of(lengths: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.empty(len(lengths), dtype=np.int64)
        n, r = lengths.to_numpy(), ranks.to_numpy()
        for value in np.unique(n):
            rows = np.flatnonzero(n == value)
            first, start, each = places.value[int(value)]
            k = np.searchsorted(first, r[rows], side="right") - 1
            out[rows] = start[k] + (r[rows] - first[k]) // each[k]
        return pd.Series(out)

    salts = max(1, -(-sum(histogram.values()) // RANKED_ROWS))
    full = items.filter("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = full.groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small(written(counts.select("n_tokens", "salt", before.alias("before")), "offsets"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece", "start"))
    ranked = full.withColumn("k", rank).join(offsets, ["n_tokens", "salt"])
    packed = ranked.select(bin_of("n_tokens", F.col("before") + F.col("k") - 1).alias("bin_id"), "doc_id", "piece", "start", "end", "n_tokens")
    none = items.filter("n_tokens = 0").select(F.lit(None).cast("bigint").alias("bin_id"), "doc_id", "piece", "start", "end", "n_tokens")
    return packed.unionByName(none)


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container."""
    return pack(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: their number, the least possible, tokens, and the share of capacity used."""
    bins = p7_bins(spark, sf_dir).filter("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    out = bins.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return out.select("containers", F.ceil(F.col("tokens") / CAPACITY).alias("least"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("used"))
