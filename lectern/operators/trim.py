"""Trimming of matter that is not the book, dedupe and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Patterns of boilerplate, a named front section, headings of what follows a book.
FRONT = [
    r"^\s*produced by",
    r"transcriber'?s?\s*[’']?s?\s*note",
    r"project gutenberg",
    r"e-?text (?:prepared|produced) by",
    r"^\s*(?:copyright\b|©)",
    r"all rights reserved",
    r"first (?:published|edition)",
]
FRONT_SECTION = r"(?iu)^\s*(?:introduction|pr[ée]face|prologue|foreword|avant-propos|avertissement)\b"
BACK_HEADINGS = [
    "bibliographie", "bibliography", "notes", "index", "appendix", "appendice", "appendices", "glossaire", "glossary",
    "works cited", "œuvres citées", "oeuvres citées", "table des matières",
    "abbreviations", "abréviations", "chronologie", "chronology",
]
FRONT_SHARE = 0.25
LIMIT = 2000


def is_front_matter(text: Column) -> Column:
    """Known boilerplate, or a short line of capitals without a sentence; a named front section is the book."""
    t = strip(text)
    fragment = (F.length(t) <= 60) & t.rlike(r"\p{L}") & ~t.rlike(r"\p{Ll}") & ~t.rlike(r"[.!?]$")
    return (t != "") & ~t.rlike(FRONT_SECTION) & (t.rlike("(?i)" + "|".join(FRONT)) | fragment)


def is_back_heading(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), r"\.+$", "")).isin(*BACK_HEADINGS)


def trim_matter(paragraphs: DataFrame) -> DataFrame:
    """The body of each book: (book, ch_idx, num, p_idx, text) rows that are neither front nor back matter.

    Where chapters are numbered: the first to the last numbered one, and nothing from a back
    heading on in the latter half; unless more than a quarter of the book stands before it.
    Else leading boilerplate goes. A book is never left empty. Chapters keep their parts.
    """
    every = Window.partitionBy("book")
    size = F.length("text")
    p = paragraphs.withColumns({"lo": F.min(F.when(F.col("num").isNotNull(), F.col("ch_idx"))).over(every), "hi": F.max(F.when(F.col("num").isNotNull(), F.col("ch_idx"))).over(every)})
    p = p.withColumns({"head": F.sum(F.when(F.col("ch_idx") < F.col("lo"), size).otherwise(0)).over(every), "all": F.sum(size).over(every)})
    p = p.withColumn("numbered", F.col("lo").isNotNull() & (F.col("head") <= F.col("all") * FRONT_SHARE))
    place = F.struct("ch_idx", "p_idx")
    real = F.min(F.when(~is_front_matter(F.col("text")), place)).over(every)
    p = p.withColumn("real", real)
    inside = F.when(F.col("numbered"), F.col("ch_idx").between(F.col("lo"), F.col("hi"))).otherwise(F.col("real").isNull() | (place >= F.col("real")))
    p = p.filter(inside)
    chapters = F.dense_rank().over(Window.partitionBy("book").orderBy("ch_idx"))
    p = p.withColumn("rank", chapters - 1).withColumn("n", F.max(F.col("rank") + 1).over(every))
    back = F.min(F.when(F.col("numbered") & (F.col("rank") >= F.floor(F.col("n") / 2)) & is_back_heading(F.col("text")), place)).over(every)
    p = p.withColumn("back", back).withColumn("first", F.min(place).over(every))
    keep = F.col("back").isNull() | (place < F.col("back")) | (F.col("back") == F.col("first"))
    return p.filter(keep).select(paragraphs.columns)


def trim_edges(pages: DataFrame, apparatus: Column) -> DataFrame:
    """Pages (book, pos) without the apparatus at a book's two ends."""
    every = Window.partitionBy("book")
    lo, hi = F.min(F.when(~apparatus, F.col("pos"))).over(every), F.max(F.when(~apparatus, F.col("pos"))).over(every)
    return pages.withColumns({"lo": lo, "hi": hi}).filter(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def without_notes(text: Column) -> Column:
    """Predicate: the paragraph is no note of the published edition."""
    return ~text.rlike(r"^\[\d+\]")


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units (h, pos, ...) not yet in ``done`` (h): the first of each hash, in order.

    The window runs over one hash; the hottest hash is cut down before it by a partial minimum.
    """
    first = units.groupBy("h").agg(F.min("pos").alias("pos"))
    return first.join(done.select("h").distinct(), "h", "left_anti").join(units, ["h", "pos"]).dropDuplicates(["h", "pos"])


def drop_leading(paragraphs: DataFrame, n: Column | int, book: str = "book") -> DataFrame:
    """Without the first ``n`` paragraphs of a book, chapter borders aside."""
    return paragraphs.filter(F.col("pos") >= n)


def over_limit(paragraphs: DataFrame, book: str = "book", limit: int = LIMIT) -> DataFrame:
    """Books of more than ``limit`` paragraphs, which need force to go on."""
    return paragraphs.groupBy(book).agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def page_of(groups: Column, page: Column) -> Column:
    """The page shown for a wish: round the book again past its end."""
    return F.pmod(page, groups)


def positional_window(at: Column, total: Column, other: Column, page: int, width: int) -> tuple[Column, Column]:
    """(first, end) of the rows of the other edition around a page, by position (half to even)."""
    middle = F.bround(at / total * other).cast("bigint")
    return F.greatest(middle - width, F.lit(0)), F.least(middle + page + width, other)
