"""Text repair: each operator keeps what it can prove from the file and reports what it removes.

Inputs are texts (doc, text) or lines (doc, line_no, line). Line operators are windows over
one document; ``doc`` is the only shuffle key. NULL texts and lines count as none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.numbers import chapter_number
from lectern.functions.text import BLANK, is_blank, rstrip, squeeze, strip, upper_median, upper_median_of, without_format

# Fixed values of the repair rules.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PAGE_MARK = r"(?i)\[\s*(?:pg|page)\.?\s*[ivxlcdm\d]+\s*\]"
SENTENCE_END, SENTENCE_START = r"[.!?…][\"”»’']?$", r"^[\"“«‘(]?[A-ZÀ-Þ]"
CLOSED = r"[.!?…:;—–][\"”»’')\]]?$"
OPENED = r"^(?:[—–]\s|[\"“«'(]?[A-ZÀ-Þ])"
SHORT_LINE, UNBROKEN_BLOCK, LINE_BLOCK, LINE_BLOCK_SHARE, ENOUGH_BLOCKS, LINE_BLOCK_CLOSES = 0.8, 2000, 200, 0.9, 20, 0.4
INDENT_SHARE, HEADING_LINE = 0.1, 0.5
MENU = ("Ajouter des langues", "Texte", "Source", "Discussion", "Lire", "Modifier", "Voir l’historique", "Voir l'historique", "Outils", "Apparence masquer", "Télécharger")
NAVIGATION = r"^\s*[◄◀]\s*\S.*$|^.*\S\s*[►▶]\s*$|^\s*[▲^]\s*$|(?i:^Catégorie(?:s)?\s*:)|^\S.*/Texte entier$|^<\s+\S"
PUBLIC_DOMAIN = r"(?i)domaine public|this work is in the public domain"
LICENCE = r"(?im)^\*\*\*\s*{0} OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*\*\*\*\s*$"
PAGE_NUMBER, CITATION, BARE_YEAR = r"^\[?\d{1,4}\]?$", r"\(\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*\)", r"^\(\s*\d{3,4}\s*\)$"
NOTE_BODY = r"^\[\d{1,3}\]\s"
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹"
TRUSTED, SHORTEST_JOIN = 3, 6


def by_line(*more: str) -> Window:
    return Window.partitionBy("doc", *more).orderBy("line_no")


def removals(rows: DataFrame, stage: str, kind: Column | str, detail: Column) -> DataFrame:
    """The side output of every cleaning step: (doc, line_no, stage, kind, detail)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select("doc", "line_no", F.lit(stage).alias("stage"), kind.alias("kind"), detail.alias("detail"))


# --- projections ------------------------------------------------------------------------


def expand_ligatures(text: Column) -> tuple[Column, Column]:
    """(text with letters for ligatures, how many there were)."""
    out = text
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out, F.regexp_count(text, F.lit("[ﬀ-ﬆ]"))


def remove_page_marks(text: Column) -> tuple[Column, Column]:
    """(text with one space for each stamp of a page, how many)."""
    return F.regexp_replace(text, PAGE_MARK, " "), F.regexp_count(text, F.lit(PAGE_MARK))


def blocks(text: Column) -> Column:
    """Blocks between blank lines, blank ones left out."""
    return F.filter(F.split(text, rf"\n{BLANK}*\n"), lambda b: ~is_blank(b))


# --- evidence of one document -----------------------------------------------------------


def measure(line_array: Column) -> Column:
    """The measure the page is set to: the stripped length nine tenths up the sorted non-blank lines."""
    lengths = F.array_sort(F.filter(F.transform(line_array, lambda x: F.length(strip(x))), lambda n: n > 0))
    at = F.floor(F.size(lengths) * F.lit(0.9)).cast("int") + 1
    return F.coalesce(F.try_element_at(lengths, at), F.lit(0))


def layout(texts: DataFrame) -> DataFrame:
    """(doc, measure, n_blocks, block_median, never_broke, broke_every_line): how a file breaks its text."""
    b = texts.select("doc", F.split("text", "\n").alias("l"), F.transform(blocks(F.col("text")), strip).alias("b"))
    b = b.withColumns({"m": measure(F.col("l")), "single": F.filter("b", lambda x: ~x.contains("\n"))})
    lengths = F.transform("b", F.length)
    typical = upper_median(F.transform("single", F.length))
    closing = F.size(F.filter("single", lambda x: x.rlike(CLOSED)))
    n, k = F.size("b"), F.size("single")
    each = (n >= ENOUGH_BLOCKS) & (k >= n * LINE_BLOCK_SHARE) & (typical <= LINE_BLOCK) & (typical >= F.col("m") * SHORT_LINE) & (closing < k * LINE_BLOCK_CLOSES)
    return b.select("doc", F.col("m").alias("measure"), n.alias("n_blocks"), upper_median(lengths).alias("block_median"), F.coalesce(upper_median(lengths) > UNBROKEN_BLOCK, F.lit(False)).alias("never_broke"), F.coalesce(each, F.lit(False)).alias("broke_every_line"))


def indent_marks(lines: DataFrame) -> DataFrame:
    """(doc, mark): the column at which paragraphs begin, 0 without the convention.

    The most common indent is flush; of the deeper ones the most common counts if it takes a
    tenth of the lines and fewer than the flush ones. Ties go to the indent seen first.
    """
    rows = lines.filter(~is_blank(F.col("line"))).select("doc", "line_no", (F.length("line") - F.length(F.ltrim("line"))).alias("col"))
    n = rows.groupBy("doc", "col").agg(F.count("*").alias("n"), F.min("line_no").alias("seen"))
    rank = F.struct("n", (-F.col("seen")).alias("s"), "col")
    flush = n.groupBy("doc").agg(F.max(rank).alias("f"), F.sum("n").alias("all"))
    deeper = n.join(flush, "doc").filter(F.col("col") > F.col("f.col")).groupBy("doc").agg(F.max(rank).alias("d"))
    both = flush.join(deeper, "doc", "left")
    good = (F.col("d.n") >= F.col("all") * INDENT_SHARE) & (F.col("d.n") < F.col("f.n"))
    mark = F.col("f.col") + F.floor((F.col("d.col") - F.col("f.col") + 1) / 2)
    return both.select("doc", F.when(F.coalesce(good, F.lit(False)), mark).otherwise(0).cast("int").alias("mark"))


# --- line windows -----------------------------------------------------------------------


def rejoin_headings(lines: DataFrame) -> DataFrame:
    """Lines with a numeral that stands up to three lines below its lone heading word (blank between) pulled up to it."""
    w = by_line()
    head = F.lower(F.regexp_replace(strip(F.col("line")), r"\.+$", "")).isin("chapitre", "chapter")
    ahead = [F.lead("line", k).over(w) for k in (1, 2, 3)]
    empty = [a.isNotNull() & is_blank(a) for a in ahead]
    place = F.when(~empty[0] & ahead[0].isNotNull(), 1).when(empty[0] & ~empty[1] & ahead[1].isNotNull(), 2).when(empty[0] & empty[1] & ahead[2].isNotNull(), 3)
    found = lines.withColumns({"head": head, "place": place, **{f"a{k}": ahead[k - 1] for k in (1, 2, 3)}})
    numeral = F.when(F.col("place") == 1, strip(F.col("a1"))).when(F.col("place") == 2, strip(F.col("a2"))).when(F.col("place") == 3, strip(F.col("a3")))
    found = found.withColumn("numeral", F.when(F.col("head"), numeral))
    found = found.withColumn("takes", F.when(chapter_number(F.col("numeral")).isNotNull(), F.col("place")))
    gone = F.lit(False)
    for k in (1, 2, 3):
        gone = gone | F.coalesce(F.lag("takes", k).over(w) >= k, F.lit(False))
    found = found.withColumn("gone", gone)
    line = F.when(F.col("takes").isNotNull(), F.concat(rstrip(F.col("line")), F.lit(" "), F.col("numeral"))).otherwise(F.col("line"))
    return found.filter(~F.col("gone")).select("doc", "line_no", line.alias("line"), F.col("takes").isNotNull().alias("joined"))


def dehyphenate_lines(lines: list[str]) -> tuple[list[str], int]:
    """Lines with words whole that a hyphen parts: the word's rest moves up from a line that resumes in small letters.

    What a line keeps after giving its first word is judged like any line.
    """
    out: list[str] = []
    healed = 0
    for line in lines:
        above = out[-1].rstrip() if out else ""
        if len(above) > 1 and above[-1] == "-" and (above[-2].isalnum() or above[-2] == "_") and line[:1].islower():
            word, _, line = line.strip().partition(" ")
            out[-1] = above[:-1] + word
            healed += 1
        out.append(line)
    return out, healed


HEALED = T.StructType([T.StructField("text", T.StringType()), T.StructField("healed", T.IntegerType())])


@F.pandas_udf(HEALED)
def dehyphenate(s: pd.Series) -> pd.DataFrame:
    rows = [dehyphenate_lines(t.split("\n")) if t is not None else (None, None) for t in s]
    return pd.DataFrame([(None if a is None else "\n".join(a), n) for a, n in rows], columns=["text", "healed"])


def unfuse(lines: DataFrame) -> DataFrame:
    """Lines with ``breaks``: whether a paragraph ends behind this line (short of the measure,
    closing a sentence, with one beginning below)."""
    per = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    m = per.select("doc", measure(F.col("a.line")).alias("measure"))
    below = strip(F.coalesce(F.lead("line").over(by_line()), F.lit("")))
    here = strip(F.col("line"))
    rows = lines.withColumn("below", below).join(m, "doc")
    ends = (F.length(here) > 0) & (F.length(here) < F.col("measure") * SHORT_LINE) & here.rlike(SENTENCE_END) & F.col("below").rlike(SENTENCE_START)
    return rows.select("doc", "line_no", "line", ends.alias("breaks"))


def split_on_indent(lines: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Non-blank lines with ``starts``: whether a paragraph begins at this line, by the file's indents.

    An indented line begins one unless prose plainly runs through it; a short, closed flush
    line between a finished text and an indented line stands alone as a heading.
    """
    marks = indent_marks(lines) if marks is None else marks
    per = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    ms = per.select("doc", measure(F.col("a.line")).alias("measure"))
    w = by_line()
    rows = lines.withColumn("above_blank", F.coalesce(is_blank(F.lag("line").over(w)), F.lit(True))).filter(~is_blank(F.col("line")))
    rows = rows.withColumns({"last": F.lag("line").over(w), "next": F.coalesce(F.lead("line").over(w), F.lit(""))})
    rows = rows.join(marks, "doc").join(ms, "doc").filter("mark > 0")
    here, above = strip(F.col("line")), strip(F.col("last"))
    indent = lambda c: F.length(c) - F.length(F.ltrim(c))
    by_mark = (indent(F.col("line")) >= F.col("mark")) & (above.rlike(CLOSED) | here.rlike(OPENED))
    alone = (indent(F.col("line")) < F.col("mark")) & (F.col("measure") > 0) & (F.length(here) < F.col("measure") * HEADING_LINE) & here.rlike(CLOSED)
    alone = alone & (F.length("next") > 0) & (indent(F.col("next")) >= F.col("mark")) & (F.col("above_blank") | above.rlike(CLOSED))
    starts = F.col("last").isNotNull() & (by_mark | alone)
    return rows.select("doc", "line_no", "line", F.col("mark"), starts.alias("starts"))


# --- stripping --------------------------------------------------------------------------


def licence_body(text: Column) -> Column:
    """What stands between the licence marks, if both are there in order; else the text."""
    start, end = LICENCE.format("START"), LICENCE.format("END")
    after = F.regexp_replace(text, rf"(?s:\A.*?)(?:{start})", "")
    inside = F.regexp_replace(after, rf"(?:{end})(?s:.*)\z", "")
    return F.when(text.rlike(start) & after.rlike(end), inside).otherwise(text)


def strip_boilerplate(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) lines: notes behind the first arrow line, menus, navigation, notices, invisible lines."""
    notes = F.min(F.when(F.ltrim("line").startswith("↑"), F.col("line_no"))).over(Window.partitionBy("doc"))
    clean = strip(without_format(F.col("line")))
    kind = (
        F.when(F.col("line_no") >= notes, "note apparatus")
        .when((strip(F.col("line")) != "") & (clean == ""), "invisible")
        .when(clean.isin(*MENU), "menu")
        .when((clean != "") & clean.rlike(NAVIGATION), "navigation")
        .when((clean != "") & clean.rlike(PUBLIC_DOMAIN), "notice")
    )
    judged = lines.withColumn("kind", kind)
    gone = judged.filter("kind is not null").filter(strip(F.col("line")) != "")
    return judged.filter("kind is null").drop("kind"), removals(gone, "boilerplate", F.col("kind"), strip(F.col("line")))


def build_blocks(texts: DataFrame) -> DataFrame:
    """(doc, block, lines, kind): blocks of squeezed lines; ``kind`` names why one is removed, NULL if it is kept.

    Bare page numbers go from any block. While nothing is kept yet a citation or a bare year
    is the transcription's header; note bodies go anywhere, and note references inside lines.
    """
    b = texts.select("doc", F.posexplode(F.split(strip(F.col("text")), rf"\n{BLANK}*\n+")).alias("block", "b"))
    clean = F.filter(F.transform(F.split("b", "\r?\n"), squeeze), lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))
    b = b.select("doc", "block", clean.alias("lines")).filter(F.size("lines") > 0)
    first = F.element_at("lines", 1)
    prose = F.exists("lines", lambda x: x.rlike(r"[\p{L}\p{N}]"))
    cite = F.exists("lines", lambda x: x.rlike(CITATION))
    year = (F.size("lines") == 1) & first.rlike(BARE_YEAR)
    kind = F.when(~prose, "not prose").when(cite, "citation?").when(year, "year?").when(first.rlike(NOTE_BODY), "note text")
    b = b.withColumn("kind", kind)
    # a block with a citation or year is only header material before the first plainly kept block;
    # one that is kept itself ends the header
    plain = F.min(F.when(F.col("kind").isNull(), F.col("block"))).over(Window.partitionBy("doc"))
    body = F.col("block") > F.coalesce(plain, F.lit(2147483647))
    kind = F.when(F.col("kind").isin("citation?", "year?"), F.when(~body, F.regexp_replace("kind", r"\?", "")).when(first.rlike(NOTE_BODY), "note text")).otherwise(F.col("kind"))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, r"(?<=.)\[\d{1,3}\]", ""))
    return b.select("doc", "block", F.when(kind.isNull(), bare).otherwise(F.col("lines")).alias("lines"), kind.alias("kind"))


# --- notes ------------------------------------------------------------------------------


def _superscript(token: Column) -> Column:
    return F.translate(token, SUPERSCRIPTS, "123456789")


def note_number(text: Column) -> Column:
    """The number a paragraph claims as a note's body, by how it opens."""
    found = F.regexp_extract(text, rf"^(?:\[(\d{{1,3}})\]\s+|\((\d{{1,3}})\)\s+|([{SUPERSCRIPTS}])\s*|(\d{{1,3}})\.\s+)", 0)
    token = F.regexp_extract(found, rf"(\d{{1,3}}|[{SUPERSCRIPTS}])", 1)
    return F.when(token != "", _superscript(token).cast("int"))


def note_references(text: Column) -> Column:
    """Numbers that prose points at, glued to the word before."""
    by_sign = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?<=\S)\[(\d{1,3})\]", r"(?<=[\p{L}\p{N}_])\((\d{1,3})\)", rf"(?<=\S)([{SUPERSCRIPTS}])")]
    return F.transform(F.concat(*by_sign), lambda t: _superscript(t).cast("int"))


def remove_notes(paragraphs: DataFrame) -> DataFrame:
    """(doc, pos, text, note): ``note`` is the number of a paragraph that is a note: one the
    prose points at, or one of a counting run of at least two that closes the chapter."""
    p = paragraphs.withColumn("n", note_number(F.col("text")))
    refs = paragraphs.select("doc", F.explode(note_references(F.col("text"))).alias("n")).distinct().withColumn("pointed", F.lit(True))
    back = Window.partitionBy("doc").orderBy(F.desc("pos"))
    follows = F.lag("n").over(back)
    broken = F.when(F.col("n").isNull() | (F.lag("pos").over(back).isNotNull() & ~follows.eqNullSafe(F.col("n") + 1)), 1).otherwise(0)
    p = p.withColumn("broken", broken)
    p = p.withColumn("broken", F.sum("broken").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("run", F.count_if(F.col("broken") == 0).over(Window.partitionBy("doc")))
    p = p.join(refs, ["doc", "n"], "left")
    is_note = F.col("n").isNotNull() & (F.coalesce("pointed", F.lit(False)) | ((F.col("broken") == 0) & (F.col("run") >= 2)))
    return p.select("doc", "pos", "text", F.when(is_note, F.col("n")).alias("note"))


FUSED = re.compile(r"(?:^|(?<=\s))[\[(](\d{1,3})[\])]\s*[-–—]?\s+")
FUSED_NOTES = T.StructType([T.StructField("prose", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))])


def unfuse_notes(text: str) -> tuple[str, list[str]]:
    """(prose, notes) of a paragraph that carries a whole apparatus: at least three openings counting from 1."""
    run: list[re.Match] = []
    for m in FUSED.finditer(text):
        if run and int(m.group(1)) != int(run[-1].group(1)) + 1:
            run = []
        if run or int(m.group(1)) == 1:
            run.append(m)
    if len(run) < 3:
        return text, []
    ends = [m.start() for m in run[1:]] + [len(text)]
    return text[: run[0].start()].strip(), [text[m.start() : e].strip() for m, e in zip(run, ends)]


@F.pandas_udf(FUSED_NOTES)
def fused_notes(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unfuse_notes(t) if t is not None else (None, None) for t in s], columns=["prose", "notes"])


# --- spacing ----------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]{2,}"), F.lit(0))


def run_together(paragraphs: DataFrame, book: str = "doc") -> DataFrame:
    """(book, word, left, right): words of at least six letters that the book does not use
    (fewer than three times) and that part into two words it does use. Ties keep all splits."""
    n = paragraphs.select(book, F.explode(words(F.col("text"))).alias("word")).groupBy(book, "word").agg(F.count("*").alias("n"))
    trusted = n.filter(F.col("n") >= TRUSTED).select(book, "word")
    rare = n.filter((F.col("n") < TRUSTED) & (F.length("word") >= SHORTEST_JOIN)).select(book, "word")
    cuts = rare.select(book, "word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i"))
    cuts = cuts.select(book, "word", F.expr("left(word, i)").alias("left"), F.expr("substr(word, i + 1)").alias("right"))
    cuts = cuts.join(trusted.withColumnRenamed("word", "left"), [book, "left"], "left_semi")
    return cuts.join(trusted.withColumnRenamed("word", "right"), [book, "right"], "left_semi").select(book, "word", "left", "right")


def suspects(paragraphs: DataFrame, joins: DataFrame, book: str = "doc") -> DataFrame:
    """Paragraphs that hold a run-together word."""
    cases = joins.select(book, "word").distinct()
    held = paragraphs.select(book, "pos", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(cases, [book, "word"], "left_semi")
    return paragraphs.join(held.select(book, "pos").distinct(), [book, "pos"], "left_semi")


QUOTES = "'‘’“”«»\"`´"


def respaced(original: Column, reply: Column) -> Column:
    """The original's characters at the reply's spacing; NULL if the reply is another text or changes nothing.

    Quotation marks of any shape answer for one another.
    """
    bare = lambda t: F.translate(F.regexp_replace(t, rf"{BLANK}+", ""), QUOTES, "'" * len(QUOTES))
    ours = F.split(F.regexp_replace(original, rf"{BLANK}+", ""), "")
    parts = F.split(squeeze(reply), " ")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    step = lambda a, w: F.struct(F.concat(a["out"], F.array(F.array_join(F.slice(ours, a["at"] + 1, F.length(w)), ""))).alias("out"), (a["at"] + F.length(w)).alias("at"))
    made = F.aggregate(parts, start, step, lambda a: F.array_join(a["out"], " "))
    return F.when((bare(original) == bare(reply)) & (made != original), made)


def changed_words(before: Column, after: Column) -> Column:
    """Words of the text before that are not in it after, in order."""
    return F.filter(F.split(squeeze(before), " "), lambda w: ~F.array_contains(F.split(squeeze(after), " "), w))


def usable(paragraphs: DataFrame, limit: int = 6000) -> DataFrame:
    """(doc, n, typical, usable): whether a book has paragraphs of a length that can be aligned."""
    per = paragraphs.select("doc", F.length("text").alias("l")).groupBy("doc").agg(F.count("*").alias("n"), upper_median_of("l").alias("typical"))
    return per.withColumn("usable", F.col("typical") <= limit)
