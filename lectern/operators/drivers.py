"""Compositions: the repair of one file's text, the alignment of two editions, the build of a reader.

Each runs the operators in the order their evidence needs; nothing is decided on the driver, and
books of different kinds go through their branches beside each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import content_hash, is_blank
from lectern.operators import align as al
from lectern.operators import enrich as en
from lectern.operators import kernels as kn
from lectern.operators import repair as rp
from lectern.operators import trim as tr
from lectern.session import written

REPORT = ("ligatures", "page_marks", "line_blocks", "headings", "healed", "indented", "restored")


def _texts(lines: DataFrame, gap) -> DataFrame:
    """(doc, text) of lines (doc, line_no, line); ``gap`` is what stands before a line that is not the first."""
    rows = lines.select("doc", F.struct("line_no", gap.alias("gap"), "line").alias("r"))
    joined = F.aggregate(F.array_sort(F.collect_list("r")), F.lit(None).cast("string"), lambda t, r: F.when(t.isNull(), r["line"]).otherwise(F.concat(t, r["gap"], r["line"])))
    return rows.groupBy("doc").agg(joined.alias("text"))


def repair_texts(texts: DataFrame) -> DataFrame:
    """(doc, text, and how often each repair was made) of texts (doc, text, pdf).

    Ligatures, page marks, line breaks read as paragraph breaks, split headings, line-broken words;
    then the paragraphs: by indents where the file indents, else by short lines where the file is a
    PDF or lost its paragraphs. Texts without lines stay as they are; NULL texts give no row.
    """
    expanded, ligatures = rp.expand_ligatures(F.col("text"))
    unmarked, marks = rp.remove_page_marks(F.col("text"))
    t = texts.filter("doc is not null and text is not null").select("doc", "pdf", expanded.alias("text"), ligatures.alias("ligatures"))
    t = written(t.select("doc", "pdf", "ligatures", unmarked.alias("text"), marks.alias("page_marks")), "marked")
    shape = written(rp.layout(t).select("doc", "n_blocks", "never_broke", "broke_every_line"), "shape")
    lines = t.join(shape, "doc").select("doc", "broke_every_line", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(~(F.col("broke_every_line") & is_blank(F.col("line")))).select("doc", "line_no", "line")
    lines = written(lines, "lines")
    indents = rp.indent_marks(lines)
    joined = written(rp.rejoin_headings(lines), "joined")
    headings = joined.groupBy("doc").agg(F.count_if("joined").alias("headings"))
    whole = _texts(joined, F.lit("\n")).select("doc", rp.dehyphenate("text").alias("r")).select("doc", F.col("r.text").alias("text"), F.col("r.healed").alias("healed"))
    whole = written(whole.join(headings, "doc").join(indents, "doc", "left").na.fill(0, ["mark"]), "whole")
    flags = whole.join(shape, "doc").join(t.select("doc", "pdf"), "doc").select("doc", "mark", (F.coalesce("pdf", F.lit(False)) | F.col("broke_every_line") | F.col("never_broke")).alias("short"))
    again = whole.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = written(rp.split_on_indent(again.join(flags.filter("mark > 0").select("doc"), "doc", "left_semi"), whole.select("doc", "mark")), "indented")
    by_indent = _texts(marked, F.when(F.col("starts"), F.lit("\n\n")).otherwise(F.lit("\n"))).join(marked.groupBy("doc").agg(F.count_if("starts").alias("indented")), "doc")
    short = rp.unfuse(again.join(flags.filter("mark = 0 and short").select("doc"), "doc", "left_semi"))
    behind = F.lag("breaks").over(rp.by_line())
    short = written(short.withColumn("after", F.coalesce(behind, F.lit(False))), "short")
    by_length = _texts(short, F.when(F.col("after"), F.lit("\n\n")).otherwise(F.lit("\n"))).join(short.groupBy("doc").agg(F.count_if("breaks").alias("restored")), "doc")
    done = by_indent.withColumn("restored", F.lit(0).cast("bigint")).unionByName(by_length.withColumn("indented", F.lit(0).cast("bigint")))
    out = t.select("doc", "ligatures", "page_marks").join(shape, "doc").join(whole.select("doc", F.col("text").alias("plain"), "healed", "headings"), "doc").join(done, "doc", "left")
    blocks = F.when(F.col("broke_every_line"), F.col("n_blocks")).otherwise(0).alias("line_blocks")
    return out.select("doc", F.coalesce("text", "plain").alias("text"), "ligatures", "page_marks", blocks, "headings", "healed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("indented", "restored"))).select("doc", "text", *(F.col(c).cast("bigint").alias(c) for c in REPORT))


def align_editions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(book, pos, value, method): the right edition's text beside every left paragraph.

    ``left`` and ``right`` are (book, pos, text, num), num the chapter's number. A book whose
    chapters are numbered on both sides is aligned chapter by chapter, level at shared names and
    numbers; one with enough agreements over the whole book by these; any other in proportion.
    A left chapter whose number the right side lacks gets ''. A book without right side has no rows.
    """
    left, right = (written(s.select("book", F.col("pos").cast("bigint").alias("pos"), "text", "num"), "side") for s in (left, right))
    numbered = lambda s, name: s.groupBy("book").agg(F.count_distinct("num").alias(name))
    pins = al.rare_agreements(left, right).unionByName(al.shared_starts(left, right).select("book", "l", "r")).distinct()
    runs = written(al.longest_run(written(pins, "pins")), "runs")
    found = numbered(left, "a").join(numbered(right, "b"), "book").join(runs.groupBy("book").agg(F.count("*").alias("pins")), "book", "left").na.fill(0, ["pins"])
    method = al.alignment_strategy(F.lit(False), F.lit(False), F.col("a"), F.col("b"), F.col("pins"))
    methods = written(found.select("book", method.alias("method")), "methods")
    of = lambda s, name: s.join(methods.filter(F.col("method") == name).select("book"), "book", "left_semi")
    as_group = lambda s: s.withColumnRenamed("book", "group")
    chapter = lambda s: of(s, "numbered").select(F.struct("book", F.coalesce("num", F.lit(0)).alias("num")).alias("key"), "pos", "text").select(F.to_json("key").alias("group"), "pos", "text", F.col("key.book").alias("book"))
    by_number = al.place_texts(chapter(left), chapter(right), al.chapter_flow)
    by_number = by_number.join(chapter(left).select("group", "book").distinct(), "group").select("book", "pos", "value")
    by_pins = al.anchored_texts(as_group(of(left, "anchored")), as_group(of(right, "anchored")), as_group(of(runs, "anchored"))).withColumnRenamed("group", "book")
    in_proportion = al.place_texts(as_group(of(left, "proportional")), as_group(of(right, "proportional"))).withColumnRenamed("group", "book")
    return by_number.unionByName(by_pins.select("book", "pos", "value")).unionByName(in_proportion.select("book", "pos", "value")).join(methods, "book")


def in_proportion(left: DataFrame, right: DataFrame) -> DataFrame:
    """(book, pos, value): the positional build, text shared out or poured over the whole book whatever its chapters."""
    side = lambda s: s.select(F.col("book").alias("group"), F.col("pos").cast("bigint").alias("pos"), "text")
    return al.place_texts(side(left), side(right), kn.match_by_length).withColumnRenamed("group", "book")


def build_reader(chapters: DataFrame, complete: Callable[[str, str, str], str], published: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, refused): books trimmed, gated, translated and set beside their published translation.

    ``chapters`` and ``published`` are (book, ch_idx, num, p_idx, text). ``pairs`` are (book, pos,
    num, h, text, translation, published, method) in reading order; without a published edition
    those two are ''. A book whose paragraphs are too long to be aligned, on either side, is
    refused and has no pairs: (book, typical).
    """
    keep = ["book", "ch_idx", "num", "p_idx", "text"]
    body = lambda c: written(tr.trim_matter(c.select(*keep).filter("text is not null")).withColumn("pos", F.row_number().over(Window.partitionBy("book").orderBy("ch_idx", "p_idx")) - 1), "body")
    sides = [body(chapters)] + ([body(published)] if published is not None else [])
    gates = [rp.usable(s.withColumnRenamed("book", "doc")).select(F.col("doc").alias("book"), "typical", "usable") for s in sides]
    gate = gates[0] if len(gates) == 1 else gates[0].unionByName(gates[1])
    refused = gate.filter("not usable").groupBy("book").agg(F.max("typical").alias("typical"))
    sides = [s.join(refused, "book", "left_anti") for s in sides]
    units = sides[0]
    done = en.translate_in_order(units.select("book", F.col("ch_idx").alias("chapter"), "pos", "text"), complete).withColumnRenamed("value", "translation")
    pairs = units.select("book", F.col("pos").cast("bigint").alias("pos"), "num", content_hash(F.col("text")).alias("h"), "text").join(done, ["book", "pos"], "left")
    if published is None:
        return pairs.select("*", F.lit("").alias("published"), F.lit("").alias("method")), refused
    beside = align_editions(units, sides[1]).withColumnRenamed("value", "published")
    pairs = pairs.join(beside, ["book", "pos"], "left").select("book", "pos", "num", "h", "text", "translation", F.coalesce("published", F.lit("")).alias("published"), F.coalesce("method", F.lit("")).alias("method"))
    return pairs, refused


def embed_cached(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, new entries): vectors of texts (id, text) by content, from a cache (key, value) where it has them.

    A text that stands several times, or differs only in blank ends, is sent once. A vector of
    another length than most is no answer: its texts stay without vector, to be asked again.
    """
    keyed = texts.filter("text is not null").select("id", content_hash(F.trim("text")).alias("key"), F.trim("text").alias("text"))
    as_json = lambda batch: [",".join(map(repr, v)) for v in embed(batch)]
    fresh = written(en.call_batches(en.to_do(keyed.select("key", "text"), cache), as_json), "vectors")
    known = cache.select("key", "value").unionByName(fresh)
    vectors = keyed.select("id", "key").join(known, "key").select("id", "key", F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("vector"))
    most = vectors.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k")).agg(F.max_by("n", F.struct("k", "n")).alias("n"))
    width = F.broadcast(most)  # one row
    return vectors.join(width, F.size("vector") == F.col("n")).select("id", "vector"), fresh
