"""Alignment of two ordered editions: relational where it can be, grouped kernels where order decides.

Grouped operators take one (pair, chapter) a call; a book without chapter pairs is one group,
a kernel holds one row of its grid and bits or bytes of the rest, so two books of any length fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import nfkd_ascii_udf
from lectern.operators import kernels as kn
from lectern.session import small, written

# Fixed values.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its of on or she that the their them there they this to was were which who with "
    "you your not no all one two more very do did if then than when what"
).split()
FLOOR, LEAST_SHARED, COVERAGE = 0.34, 2, 0.7
PREFIX, OCCURRENCES, LEAST_ANCHORS = 6, 3, 4
MARGIN, OPENING_ROWS, OPENING_CHARS, RUN = 0.38, 60, 1200, 3
MISMATCH, LEAST_CHECKED, DIVISION = 0.25, 4, 0.8


# --- joins --------------------------------------------------------------------------------


def lookup(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Units with the text kept for their hash, '' where there is none. Of several texts of a hash the last position's stands."""
    last = texts.groupBy("h").agg(F.max_by("value", "pos").alias("value"))
    return units.join(last, "h", "left").withColumn("value", F.coalesce("value", F.lit("")))


def pair_by_number(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left chapters (book, ch_idx, part, num) with the right chapter of the same part and number.

    The first right chapter of a number stands; NULL numbers match nothing, NULL parts each other.
    """
    first = right.filter("num is not null").groupBy("book", "part", "num").agg(F.min("ch_idx").alias("other"))
    r = first.select(F.col("book").alias("b2"), F.col("part").alias("p2"), F.col("num").alias("n2"), "other")
    on = (F.col("book") == F.col("b2")) & F.col("part").eqNullSafe(F.col("p2")) & (F.col("num") == F.col("n2"))
    return left.join(r, on, "left").drop("b2", "p2", "n2")


def shared_starts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(book, num, l, r): where the shared chapter numbers begin, in paragraphs."""
    start = lambda d, name: d.filter("num is not null").groupBy("book", "num").agg(F.min("pos").alias(name))
    return start(left, "l").join(start(right, "r"), ["book", "num"])


def tokens(text: Column) -> Column:
    """Words of over two letters that are no stop words, once each."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def containment(left: DataFrame, right: DataFrame, stated: bool = False) -> DataFrame:
    """(group, l, r, shared, score): pairs sharing at least two words, over the smaller word set.

    An inverted index instead of a product: (group, word) equi-join, counted. Rows are
    (group, id, text); words of one side are joined once each. With ``stated`` the right side is
    a stated set of queries: its words are written, and broadcast if they are proven few.
    """
    a = left.select("group", F.col("id").alias("l"), tokens(F.col("text")).alias("t")).withColumn("nl", F.size("t"))
    b = right.select("group", F.col("id").alias("r"), tokens(F.col("text")).alias("t")).withColumn("nr", F.size("t"))
    hits = a.select("group", "l", "nl", F.explode("t").alias("w"))
    index = b.select("group", "r", "nr", F.explode("t").alias("w"))
    hits = hits.join(small(written(index, "queries")) if stated else index, ["group", "w"])
    n = hits.groupBy("group", "l", "r").agg(F.count("*").alias("shared"), F.first("nl").alias("nl"), F.first("nr").alias("nr"))
    return n.filter(F.col("shared") >= LEAST_SHARED).select("group", "l", "r", "shared", (F.col("shared") / F.least("nl", "nr")).alias("score"))


def rare_agreements(left: DataFrame, right: DataFrame, extra: Callable[[Column], Column] | None = None) -> DataFrame:
    """(book, l, r): paragraphs that share a token rare in both editions.

    A token's first six ASCII letters (of at least four) that stand in as many paragraphs of
    either side, three at most, pair in order. The count filter comes before the join: no hot
    token is shuffled to it.
    """

    def places(d: DataFrame, name: str) -> DataFrame:
        found = F.split(F.regexp_replace(nfkd_ascii_udf(F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}]{2,}|\d{2,}"), F.lit(0)), " ")), "[^a-z0-9]+", " "), " ")
        words = F.transform(F.filter(found, lambda w: F.length(w) >= 4), lambda w: F.left(w, F.lit(PREFIX)))
        if extra is not None:
            words = F.concat(words, extra(F.col("text")))
        t = d.select("book", "pos", F.explode(F.array_distinct(words)).alias("token"))
        n = t.groupBy("book", "token").agg(F.count("*").alias("n")).filter(F.col("n") <= OCCURRENCES)
        t = t.join(n, ["book", "token"]).withColumn("k", F.row_number().over(Window.partitionBy("book", "token").orderBy("pos")))
        return t.select("book", "token", "n", "k", F.col("pos").alias(name))

    return places(left, "l").join(places(right, "r"), ["book", "token", "n", "k"]).select("book", "l", "r").distinct()


def mutual_best(scores: DataFrame, floor: Column | float) -> DataFrame:
    """Pairs (group, l, r, score) that are each other's best and at least ``floor``; ties go to the lowest index."""
    wl, wr = Window.partitionBy("group", "l").orderBy(F.desc("score"), "r"), Window.partitionBy("group", "r").orderBy(F.desc("score"), "l")
    ranked = scores.withColumns({"kl": F.row_number().over(wl), "kr": F.row_number().over(wr)})
    return ranked.filter((F.col("kl") == 1) & (F.col("kr") == 1) & (F.col("score") >= floor)).drop("kl", "kr")


def opening_cut(pairs: DataFrame) -> DataFrame:
    """(group, l, r): where two editions first run together: the first of at least three agreements in a row.

    Agreements follow each other if both sides advance and the smaller step is one (gaps and islands).
    """
    w = Window.partitionBy("group").orderBy("l", "r")
    dl, dr = F.col("l") - F.lag("l").over(w), F.col("r") - F.lag("r").over(w)
    new = F.when((dl > 0) & (dr > 0) & (F.least(dl, dr) == 1), 0).otherwise(1)
    runs = pairs.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("group", "run").agg(F.count("*").alias("n"), F.min(F.struct("l", "r")).alias("at")).filter(F.col("n") >= RUN)
    return runs.groupBy("group").agg(F.min("at").alias("at")).select("group", "at.l", "at.r")


def opening_matter(scores: DataFrame, chars: DataFrame, margin: float = MARGIN, most: float = MISMATCH) -> DataFrame:
    """(group, l, r): how many paragraphs of either side stand before two editions first run together.

    ``scores`` (group, l, r, score) is the grid of both sides' openings, ``chars`` (group, side, pos,
    chars) the lengths of both bodies, side 'l' or 'r'. Agreements lie ``margin`` over the grid's
    median; a drop of over a quarter of its side's text is none. A group without a run has no row.
    """
    floor = scores.groupBy("group").agg((F.median("score") + margin).alias("floor"))
    start = opening_cut(mutual_best(scores.join(floor, "group"), F.col("floor")))
    sides = start.select("group", F.explode(F.create_map(F.lit("l"), F.col("l"), F.lit("r"), F.col("r"))).alias("side", "at"))
    share = chars.join(sides, ["group", "side"]).groupBy("group", "side", "at").agg(F.sum(F.when(F.col("pos") < F.col("at"), F.col("chars")).otherwise(0)).alias("before"), F.sum("chars").alias("all"))
    held = share.select("group", "side", F.when(F.col("before") <= F.col("all") * most, F.col("at")).otherwise(0).alias("at"))
    return held.groupBy("group").agg(F.max(F.when(F.col("side") == "l", F.col("at"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("at"))).alias("r")).na.fill(0, ["l", "r"])


def numbering_check(scores: DataFrame) -> DataFrame:
    """(group, checked, wrong, trusted): whether pairing by number holds: a pair is wrong if a neighbour scores higher.

    ``scores`` (group, l, r, score) hold the grid, the pair of number k being (k, k). Fewer than
    four checkable pairs are trusted, else at most a quarter wrong.
    """
    same = scores.filter("l = r").select("group", "l", F.col("score").alias("own"))
    beside = scores.filter("abs(l - r) = 1").groupBy("group", "l").agg(F.max("score").alias("other"))
    each = same.join(beside, ["group", "l"])
    n = each.groupBy("group").agg(F.count("*").alias("checked"), F.count_if(F.col("other") > F.col("own")).alias("wrong"))
    return n.withColumn("trusted", (F.col("checked") < LEAST_CHECKED) | (F.col("wrong") <= F.col("checked") * MISMATCH))


def pairing_strategy(left_chapters: Column, right_chapters: Column, left_numbered: Column, right_numbered: Column, trusted: Column) -> Column:
    """'number', 'content' or 'book': how two editions' chapters are paired."""
    numbered = (left_numbered >= 2) & (right_numbered >= 2) & (left_numbered >= left_chapters * 0.8) & (right_numbered >= right_chapters * 0.8)
    alike = (F.least(left_chapters, right_chapters) >= 3) & (F.least(left_chapters, right_chapters) >= F.greatest(left_chapters, right_chapters) * DIVISION)
    return F.when(numbered, F.when(trusted, "number").otherwise("content")).when(alike, "content").otherwise("book")


def alignment_strategy(embeds: Column, pivot: Column, left_numbered: Column, right_numbered: Column, anchors: Column) -> Column:
    """'embedding', 'pivot', 'numbered', 'anchored' or 'proportional': how one pair of editions is aligned."""
    return (
        F.when(embeds, "embedding")
        .when(pivot, "pivot")
        .when((left_numbered > 0) & (right_numbered > 0), "numbered")
        .when(anchors >= LEAST_ANCHORS, "anchored")
        .otherwise("proportional")
    )


# --- grouped --------------------------------------------------------------------------------


def _rows(columns: dict) -> pd.DataFrame:
    """A frame of plain lists; empty columns are of no number type, so that they fit any schema."""
    lists = {k: list(v) if not isinstance(v, str | int | float | np.generic) else v for k, v in columns.items()}
    n = max((len(v) for v in lists.values() if isinstance(v, list)), default=0)
    return pd.DataFrame({k: v if isinstance(v, list) else [v] * n for k, v in lists.items()}, dtype=None if n else object)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that two sides of one lineage can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _both(left: DataFrame, right: DataFrame, keep: list[str]) -> tuple:
    return _fresh(left.select("group", "pos", *keep)).groupBy("group"), _fresh(right.select("group", "pos", *keep)).groupBy("group")


def _grid(cells: pd.DataFrame, size: pd.DataFrame, rows: str, columns: str) -> kn.Grid:
    """The grid of one group from its sparse cells."""
    return kn.Grid(int(size["n"].iloc[0]), int(size["m"].iloc[0]), cells[rows].to_numpy(int), cells[columns].to_numpy(int), cells["score"].to_numpy(float))


def align_scores(scores: DataFrame, sizes: DataFrame, floor: float | None = None) -> DataFrame:
    """(group, r, l): the left paragraph each right one takes, in order, with the greatest total.

    ``scores`` (group, r, l, score) is sparse, ``sizes`` (group, n, m) counts right and left.
    With ``floor`` every cell counts at least that much, and a right paragraph on a weaker cell
    is dropped (l NULL): that is the pivot alignment; without, every one is placed.
    """

    def run(cells: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return _rows({"group": [], "r": [], "l": []})
        took = kn.monotone_match(_grid(cells, size, "r", "l"), floor)
        return _rows({"group": size["group"].iloc[0], "r": np.arange(len(took)), "l": pd.array([None if t < 0 else int(t) for t in took], dtype="Int64")})

    schema = f"group {scores.schema['group'].dataType.simpleString()}, r bigint, l bigint"
    return _fresh(scores).groupBy("group").cogroup(_fresh(sizes).groupBy("group")).applyInPandas(run, schema)


def longest_run(pairs: DataFrame, group: str = "book") -> DataFrame:
    """(group, l, r): the longest part of the agreements that goes backwards on neither side."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = kn.longest_rising(list(zip(p["l"].tolist(), p["r"].tolist())))
        return _rows({group: p[group].iloc[0], "l": [a for a, _ in found], "r": [b for _, b in found]})

    schema = f"{group} {pairs.schema[group].dataType.simpleString()}, l bigint, r bigint"
    return pairs.select(group, "l", "r").groupBy(group).applyInPandas(run, schema)


def content_pairs(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, l, r): chapters paired one to one in order by what they say; either side may be passed over."""

    def run(cells: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return _rows({"group": [], "l": [], "r": []})
        found = kn.pair_sequences(_grid(cells, size, "l", "r"))
        return _rows({"group": size["group"].iloc[0], "l": [a for a, _ in found], "r": [b for _, b in found]})

    schema = f"group {scores.schema['group'].dataType.simpleString()}, l bigint, r bigint"
    return _fresh(scores).groupBy("group").cogroup(_fresh(sizes).groupBy("group")).applyInPandas(run, schema)


def nearest_in_order(scores: DataFrame, sizes: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(group, l, r): each left row's best right row from the last hit on, if it stands out over the row's median."""

    def run(cells: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return _rows({"group": [], "l": [], "r": []})
        took = kn.nearest_forward(_grid(cells, size, "l", "r"), margin)
        rows = np.flatnonzero(took >= 0)
        return _rows({"group": size["group"].iloc[0], "l": rows, "r": took[rows]})

    schema = f"group {scores.schema['group'].dataType.simpleString()}, l bigint, r bigint"
    return _fresh(scores).groupBy("group").cogroup(_fresh(sizes).groupBy("group")).applyInPandas(run, schema)


def shared_spans(sizes: DataFrame) -> DataFrame:
    """(book, i, first, stop): which of its ``m`` units each of a book's ``n`` paragraphs takes, in proportion."""

    def run(batches):
        for batch in batches:
            rows = [(b, i, *span) for b, n, m in zip(batch["book"], batch["n"], batch["m"]) if m for i, span in enumerate(kn.share_out(int(n), int(m)))]
            yield pd.DataFrame(rows, columns=["book", "i", "first", "stop"], dtype=None if rows else object)

    return sizes.select("book", "n", "m").mapInPandas(run, f"book {sizes.schema['book'].dataType.simpleString()}, i bigint, first bigint, stop bigint")


def place_texts(left: DataFrame, right: DataFrame, spread: Callable[[list[str], list[str]], list[str]] = kn.match_by_length) -> DataFrame:
    """(group, pos, value): one right text for each left paragraph, by a kernel of two lists (a table function).

    ``left`` and ``right`` are (group, pos, text). The default fills by length; a group without
    right text gets ''.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("pos"), b.sort_values("pos")
        value = spread(a["text"].tolist(), b["text"].tolist()) if len(a) else []
        return _rows({"group": a["group"].tolist(), "pos": a["pos"].tolist(), "value": value})

    schema = f"group {left.schema['group'].dataType.simpleString()}, pos bigint, value string"
    a, b = _both(left, right, ["text"])
    return a.cogroup(b).applyInPandas(run, schema)


def anchored_texts(left: DataFrame, right: DataFrame, anchors: DataFrame) -> DataFrame:
    """(group, pos, value): left paragraphs with the right text that pins and the gaps between them give.

    ``anchors`` (group, l, r) rise on both sides; a group with fewer than four has no rows:
    the editions do not agree enough to be trusted.
    """
    pins = anchors.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.col("l").cast("bigint").alias("l"), F.col("r").cast("bigint").alias("r")))).alias("pins")).filter(F.size("pins") >= LEAST_ANCHORS)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b) or a["pins"].iloc[0] is None:
            return _rows({"group": [], "pos": [], "value": []})
        a, b = a.sort_values("pos"), b.sort_values("pos")
        found = [(int(p["l"]), int(p["r"])) for p in a["pins"].iloc[0]]
        return _rows({"group": a["group"].tolist(), "pos": a["pos"].tolist(), "value": kn.fill_between(a["text"].tolist(), b["text"].tolist(), found)})

    schema = f"group {left.schema['group'].dataType.simpleString()}, pos bigint, value string"
    held = left.select("group", "pos", "text").join(pins, "group")
    return _fresh(held).groupBy("group").cogroup(_fresh(right.select("group", "pos", "text")).groupBy("group")).applyInPandas(run, schema)


def chapter_flow(left: list[str], right: list[str]) -> list[str]:
    """One right text for each left paragraph of a chapter, level at the names and numbers both share.

    Sentences are anchored (rare tokens, numbers, both ends), the segments between matched by
    length, and each paragraph gets its sentences' share; with too few anchors length decides.
    """
    from lectern.functions.text import nfkd_ascii
    from lectern.operators.structure import number_tokens

    owner = [k for k, p in enumerate(left) for _ in kn.sentence_split(p)]
    a, b = [s for p in left for s in kn.sentence_split(p)], kn.sentence_split(" ".join(right))
    if len(a) < LEAST_ANCHORS or not b:
        return kn.match_by_length(left, right)

    def places(sentences: list[str]) -> dict[str, list[int]]:
        import re

        found: dict[str, list[int]] = {}
        for k, s in enumerate(sentences):
            words = {w[:PREFIX] for w in re.findall(r"[a-z0-9]{4,}", nfkd_ascii([s])[0])} | set(number_tokens(s))
            for w in words:
                found.setdefault(w, []).append(k)
        return found

    x, y = places(a), places(b)
    pairs = {p for w, at in x.items() if len(at) <= OCCURRENCES and len(y.get(w, ())) == len(at) for p in zip(at, y[w])}
    anchors = kn.longest_rising([*pairs, (0, 0), (len(a) - 1, len(b) - 1)])
    if len(anchors) < LEAST_ANCHORS:
        return kn.match_by_length(left, right)
    given: list[list[str]] = [[] for _ in left]
    i0 = j0 = 0
    for i, j in [*anchors, (len(a), len(b))]:
        if i > i0:
            for k, text in enumerate(kn.shape_spread(a[i0:i], b[j0:j])):
                if text:
                    given[owner[i0 + k]].append(text)
        i0, j0 = i, j
    out = [" ".join(g) for g in given]
    if all(out):
        return out
    return [x or y for x, y in zip(out, kn.match_by_length(left, right))]
