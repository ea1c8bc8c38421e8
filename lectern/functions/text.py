"""Scalar text functions. NULL in gives NULL out unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[\s\p{Z}]"


def content_hash(text: Column) -> Column:
    """The key of a text: 16 hex digits of SHA-256 over UTF-8."""
    return F.substring(F.sha2(text, 256), 1, 16)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"{BLANK}+", " "))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def without_format(text: Column) -> Column:
    """Without code points of category Cf (zero-width marks and the like)."""
    return F.regexp_replace(text, r"\p{Cf}+", "")


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def url_quote(text: Column) -> Column:
    """Percent encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(rstrip(F.substring(text, 1, most - 1)), F.lit("…")))


def safe_name(text: Column) -> Column:
    """A file name of letters, digits, dots and dashes."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}.-]+", "-"), r"^-+|-+$", "")


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def surname(name: Column) -> Column:
    return F.element_at(F.split(squeeze(name), " "), -1)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double; arrays of different length give NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_norm(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def upper_median(values: Column) -> Column:
    """The element n div 2 of the sorted array (not interpolated); NULL of an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_median_of(value: str) -> Column:
    """The same as an aggregate of a group: element n div 2 in order. It keeps a count for each
    value, never the group's rows, and combines before the shuffle."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)").cast("int")


def cut_at_word(text: Column, fraction: Column) -> Column:
    """How many characters make ``fraction`` of a text, moved on to the end of the word."""
    at = F.floor(F.length(text) * fraction).cast("int")
    nxt = F.locate(" ", F.substr(text, at + 1))
    return F.when(at >= F.length(text), F.length(text)).when(nxt > 0, at + nxt - 1).otherwise(F.length(text))


def utc(ts: Column, zone: str = "UTC") -> Column:
    return F.to_utc_timestamp(ts, zone)


def nfkd_ascii(texts: list[str | None]) -> list[str | None]:
    """ASCII letters of the compatible decomposition, lower case; letters without one vanish."""
    return [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]


def mark_fold(texts: list[str | None]) -> list[str | None]:
    """Case folded, combining marks dropped: equal for accents and case."""
    return [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold() for t in texts]


@F.pandas_udf(T.StringType())
def nfkd_ascii_udf(s: pd.Series) -> pd.Series:
    return pd.Series(nfkd_ascii(s.tolist()), dtype=object)


@F.pandas_udf(T.StringType())
def mark_fold_udf(s: pd.Series) -> pd.Series:
    return pd.Series(mark_fold(s.tolist()), dtype=object)


def slug(text: Column) -> Column:
    """Words of ASCII letters and digits joined by dashes."""
    return F.regexp_replace(F.regexp_replace(nfkd_ascii_udf(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Signs that count as one another when a surface is looked up.
TYPOGRAPHY = {
    "’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"',
    "—": "-", "–": "-", " ": " ", " ": " ", " ": " ", "…": "...",
}


def typography_fold(text: str) -> tuple[str, list[int]]:
    """(folded text, for each of its characters the offset in ``text``)."""
    pieces = [(TYPOGRAPHY.get(c, c), k) for k, c in enumerate(text)]
    return "".join(p for p, _ in pieces), [k for p, k in pieces for _ in p]
