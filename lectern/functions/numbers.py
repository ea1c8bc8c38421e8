"""Numbers as books write them: digits, Roman numerals, number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words of the two languages, with feminine and ordinal forms, without accents.
CARDINALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "vingts": 20,
    "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100, "cents": 100, "mille": 1000,
    "million": 1_000_000, "millions": 1_000_000,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16,
    "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50,
    "premier": 1, "premiere": 1, "unieme": 1, "seconde": 2, "deuxieme": 2, "troisieme": 3, "quatrieme": 4, "cinquieme": 5,
    "sixieme": 6, "septieme": 7, "huitieme": 8, "neuvieme": 9, "dixieme": 10, "onzieme": 11, "douzieme": 12,
    "treizieme": 13, "quatorzieme": 14, "quinzieme": 15, "seizieme": 16, "vingtieme": 20, "trentieme": 30,
    "quarantieme": 40, "cinquantieme": 50,
}
LABEL = r"(?iu)^\s*(?:chapitre|chapter|livre|book|partie|part)\b\s*"
ROMAN = "(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def _lookup(words: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for kv in words.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral, read right to left against the greatest sign so far; else NULL."""
    sign = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    values = F.transform(F.reverse(F.split(F.upper(text), "")), lambda c: _lookup(sign, c))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"))
    step = lambda a, v: F.struct((a["s"] + F.when(v >= a["m"], v).otherwise(-v)).alias("s"), F.greatest(a["m"], v).alias("m"))
    return F.when((F.length(text) > 0) & text.rlike(ROMAN), F.aggregate(values, start, step, lambda a: a["s"]))


def roman_text(value: Column) -> Column:
    """The Roman numeral of 1 to 3999, else NULL."""
    out = F.lit("")
    for unit, ones, five, ten in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")):
        digit = F.floor(value / unit) % 10
        forms = ["", ones, ones * 2, ones * 3, ones + five, five, five + ones, five + ones * 2, five + ones * 3, ones + ten]
        out = F.concat(out, F.element_at(F.array(*[F.lit(f) for f in forms]), (digit + 1).cast("int")))
    return F.when(value.between(1, 3999), out)


def word_value(parts: Column) -> Column:
    """The value of an array of number words: tens and units add up, ``quatre`` before ``vingt``
    multiplies, hundreds and greater words scale what stands before them."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("done"), zero.alias("part"), F.lit(False).alias("four"))

    def step(a: Column, w: Column) -> Column:
        v = _lookup(CARDINALS | ORDINALS, w).cast("bigint")
        scaled = F.greatest(a["part"], F.lit(1)) * v
        part = F.when(v >= 1000, 0).when(v == 100, scaled).when(a["four"] & w.isin("vingt", "vingts"), a["part"] + 76).otherwise(a["part"] + v)
        return F.struct((a["done"] + F.when(v >= 1000, scaled).otherwise(0)).alias("done"), part.cast("bigint").alias("part"), (w == "quatre").alias("four"))

    return F.aggregate(parts, start, step, lambda a: a["done"] + a["part"]).cast("int")


def chapter_number(token: Column) -> Column:
    """The number of a chapter token: digits, ordinal word, cardinal run, Roman numeral; 0 and others give NULL."""
    core = F.lower(F.regexp_replace(F.regexp_replace(token, LABEL, ""), r"[\s.:)\]–—-]+$", ""))
    core = F.translate(F.regexp_replace(core, r"^[\s(\[]+", ""), "éèêëàâîïôûùç", "eeeeaaiiouuc")
    parts = F.filter(F.split(core, r"[\s-]+"), lambda w: ~w.isin("et", "and", ""))
    words = F.when((F.size(parts) > 0) & F.forall(parts, lambda w: _lookup(CARDINALS | ORDINALS, w).isNotNull()), word_value(parts))
    digits = F.when(core.rlike(r"^\d{1,9}(?:er|re|e|st|nd|rd|th)?$"), F.regexp_extract(core, r"^(\d+)", 1).cast("int"))
    found = F.coalesce(digits, words, roman_value(core))
    return F.when(found > 0, found)
