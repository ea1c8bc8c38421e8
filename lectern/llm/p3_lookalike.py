"""Visually identical text: one form for texts that look alike.

Method: a batch's texts are exploded to positioned code points, the code points are joined
to two small tables (decomposition, look-alikes), marks are ordered by their class behind
their base, composed again, and the texts rebuilt by position. The explosion lives inside an
Arrow batch as arrays (a gather is the broadcast join), so no code point is ever shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import table

# Letters of other scripts and the Latin letter that looks the same.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Cherokee, other Latin shapes
    "Տ": "S", "Լ": "L", "Օ": "O", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮃ": "W",
    "Ꮓ": "Z", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭻ": "J", "Ꮶ": "K", "Ꮪ": "S", "Ꮩ": "V", "ı": "i", "ɑ": "a", "ⅼ": "l",
}
#: Decompositions that keep the look; others (superscripts, fractions, the ellipsis) are other signs.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
LIGATURES = range(0xFB00, 0xFB07)
SPACE = 0x20
DROP, BASE_END = 0xFFFFFFFF, 0x110000
#: Code points without width that Unicode calls marks or letters, besides the format class.
WIDTHLESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}


def _decomposed(ch: str) -> str:
    """The code points that ``ch`` looks like: canonical parts, and compatible ones of the same look."""
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK and ord(ch) not in LIGATURES and ord(ch) not in NUMERALS and not (unicodedata.category(ch) == "Zs" and parts[1] == "0020"):
            return ch
        parts = parts[1:]
    return "".join(_decomposed(chr(int(p, 16))) for p in parts)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """(first, more_at, more, combining class, compositions) by code point, made from Unicode's rules."""
    first = np.arange(BASE_END, dtype=np.uint32)
    length = np.ones(BASE_END, dtype=np.uint8)
    ccc = np.zeros(BASE_END, dtype=np.uint8)
    long: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11200), *range(0x1D000, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        cat = unicodedata.category(ch)
        if cat == "Cf" or cp in WIDTHLESS:
            length[cp], first[cp] = 0, DROP
            continue
        if cat == "Zs" or cp in (9, 0x0B, 0x0C, 0x85):
            first[cp] = SPACE
            continue
        out = "".join(LOOKALIKES.get(c, c) for c in _decomposed(LOOKALIKES.get(ch, ch)))
        if out != ch:
            first[cp] = ord(out[0])
            if len(out) > 1:
                length[cp], long[cp] = len(out), [ord(c) for c in out]
        canonical = unicodedata.decomposition(ch).split()
        if len(canonical) == 2 and not canonical[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (int(x, 16) for x in canonical)
            pairs[(base << 21) | mark] = cp
    more_at = np.zeros(BASE_END, dtype=np.int32)
    more: list[int] = []
    for cp, out in long.items():
        more_at[cp] = len(more)
        more.extend(out)
    return first, length, more_at, np.array([*more, 0], dtype=np.uint32), ccc, pairs


#: Texts of these signs alone are their own form: printable ASCII, composed Latin letters, plain punctuation.
STABLE = re.compile("[\n\x20-\x7e\xa1-\xac\xae-\u0130\u0132-\u024f\u2010-\u2027\u2030-\u205e]*\\Z")
#: Numerals set as one sign look like the letters they are made of.
NUMERALS = range(0x2160, 0x2180)
#: Parts of Korean syllables; a run of them is written as the syllables they make.
JAMO = re.compile("[\u1100-\u11ff]+")
#: So many code points are exploded at once.
CHUNK = 1_000_000


def skeletons(texts: list[str | None]) -> list[str | None]:
    """The form of each text in which equal look is equality. None stays None.

    Texts that are their own form pass; the others are taken in chunks of bounded size.
    """
    out: list[str | None] = list(texts)
    rows = [k for k, t in enumerate(texts) if t is not None and not STABLE.match(t)]
    some, size = [], 0
    for k in [*rows, None]:
        if k is None or some and size + len(texts[k]) > CHUNK:
            for at, form in zip(some, _exploded([texts[at] for at in some])):
                out[at] = form
            some, size = [], 0
        if k is not None:
            some.append(k)
            size += len(texts[k])
    return out


def _exploded(texts: list[str]) -> list[str]:
    """The forms of texts by code points."""
    if not texts:
        return []
    texts = [JAMO.sub(lambda m: unicodedata.normalize("NFC", m.group()), t) if JAMO.search(t) else t for t in texts]
    first, length, more_at, more, ccc, pairs = tables()
    out: list[str] = list(texts)
    rows = range(len(texts))
    cps = [np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for k in rows]
    flat = np.concatenate(cps)
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cps])
    n = length[flat]
    if (n != 1).any():  # explode: each code point to the positions of its parts
        keep = np.repeat(np.arange(len(flat)), n)
        at = np.arange(len(keep)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        source = flat[keep]
        parts = np.where(n[keep] == 1, first[source], more[more_at[source] + at])
        row = row[keep]
    else:
        parts = first[flat]
    klass = ccc[parts]
    marks = np.flatnonzero(klass)
    if len(marks):
        # marks behind one base: a stable sort by (base, class) orders each run
        base = np.cumsum(klass == 0)
        order = np.lexsort((np.arange(len(parts)), klass, base, row))
        parts, row, klass = parts[order], row[order], klass[order]
        gone = np.zeros(len(parts), dtype=bool)
        held = -1
        for k in np.flatnonzero(klass):
            if k == 0 or row[k] != row[k - 1]:
                continue
            if klass[k - 1] == 0:
                held = k - 1
            blocked = k - 1 != held and not gone[k - 1] and klass[k - 1] >= klass[k]
            made = None if blocked or held < 0 else pairs.get((int(parts[held]) << 21) | int(parts[k]))
            if made is not None:
                parts[held], gone[k] = made, True
        parts, row = parts[~gone], row[~gone]
    ends = np.searchsorted(row, np.arange(len(rows)), side="right")
    data = parts.astype("<u4").tobytes()
    start = 0
    for k, end in zip(rows, ends):
        out[k] = data[4 * start : 4 * end].decode("utf-32-le", "surrogatepass")
        start = end
    return out


CYRILLIC, GREEK = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽἀ-῿]")
OTHER_WORD = re.compile(r"\S*[Ͱ-ӿἀ-῿]\S*")


@functools.cache
def _back() -> dict[str, dict[int, str]]:
    """Latin letter to the look-alike of a script."""
    back: dict[str, dict[int, str]] = {"c": {}, "g": {}}
    for other, latin in LOOKALIKES.items():
        script = "c" if CYRILLIC.match(other) else "g" if GREEK.match(other) else None
        if script:
            back[script].setdefault(ord(latin), other)
    return back


def canonical(texts: list[str | None]) -> list[str | None]:
    """One readable form: the skeleton, with words of another script back in that script.

    A word whose skeleton keeps letters of Cyrillic or Greek is a word of that script, so its
    Latin look-alikes turn into that script's letters. It is a function of the skeleton:
    texts that look the same get the same form.
    """

    def word(m: re.Match) -> str:
        w = m.group()
        parts = unicodedata.normalize("NFD", w).translate(_back()["c" if CYRILLIC.search(w) else "g"])
        return unicodedata.normalize("NFC", parts)

    return [t if t is None or t.isascii() else OTHER_WORD.sub(word, t) for t in skeletons(texts)]


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


@F.pandas_udf(T.StringType())
def skeleton_udf(s: pd.Series) -> pd.Series:
    return pd.Series(skeletons(s.tolist()), dtype=object)


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return pd.Series(canonical(s.tolist()), dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_array_udf(s: pd.Series) -> pd.Series:
    sizes = [None if a is None else len(a) for a in s]
    flat = iter(canonical([t for a in s if a is not None for t in a]))
    return pd.Series([None if n is None else [next(flat) for _ in range(n)] for n in sizes], dtype=object)


def canonical_text(col: Column) -> Column:
    """One form of a text; NULL gives NULL, '' gives ''. Plain ASCII never leaves the JVM."""
    return F.when(col.rlike(r"^[\n\r\x20-\x7e]*$"), col).otherwise(canonical_udf(col))


def look_classes(units: DataFrame, ident: str = "h", text: str = "text") -> DataFrame:
    """(ident, look): the digest of each distinct row's form; equal look, equal digest. NULL texts are left out."""
    rows = units.select(ident, text).filter(F.col(text).isNotNull() & F.col(ident).isNotNull())
    return rows.select(ident, F.unhex(F.md5(skeleton_udf(text))).alias("look")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different h whose texts look the same."""
    looks = look_classes(table(spark, sf_dir, "unit"))
    several = looks.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    looks = looks.join(several, "look", "left_semi")
    a, b = looks.select("look", F.col("h").alias("h_a")), looks.select("look", F.col("h").alias("h_b"))
    return a.join(b, "look").filter("h_a < h_b").select("h_a", "h_b").distinct()


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its one form and the hash of that form."""
    units = table(spark, sf_dir, "unit").withColumn("form", canonical_text(F.col("text")))
    return units.select("h", "text", "lang", "chapter_id", F.col("form"), F.substring(F.sha2("form", 256), 1, 16).alias("form_h"))


def p3_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's paragraphs in one form."""
    chapters = table(spark, sf_dir, "chapter").select("chapter_id", "paragraphs")
    plain = F.forall("paragraphs", lambda p: p.isNull() | p.rlike(r"^[\n\r\x20-\x7e]*$"))
    return chapters.select("chapter_id", F.when(plain, F.col("paragraphs")).otherwise(canonical_array_udf("paragraphs")).alias("paragraphs"))
