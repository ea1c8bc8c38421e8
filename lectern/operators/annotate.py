"""Annotation: parsing a model's replies, anchoring units to exact spans, what may be shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip, typography_fold

# The closed class of French in its commonest words (a parameter of every operator),
# and the joining words between two parts of a unit.
FUNCTION_WORDS = tuple(
    (
        "le la les l un une des du de d au aux à a ce cet cette ces c mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs tout toute tous toutes "
        "je j tu il elle on nous vous ils elles me m te t se s lui y en moi toi soi eux qui que qu quoi dont où et ou mais donc or ni car si comme quand "
        "dans sur sous par pour avec sans chez vers entre depuis pendant contre selon avant après derrière devant ne n pas plus jamais rien très bien trop peu "
        "suis es est sommes êtes sont était étaient fut furent sera seront été ai as avons avez ont avait avaient eut eurent aura eu peut peuvent faut veut doit va vont"
    ).split()
)
COORDINATORS, PREPOSITIONS = ("et", "ou", "ni", "mais"), ("de", "du", "des", "d", "à", "au", "aux", "en")
MARKER = r"(?m)^@@@(\d+)@@@[ \t]*$"
UNIT = "struct<surface:string,pos:string,gloss:string,infinitive:string>"
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pos", T.StringType()), T.StructField("gloss", T.StringType()), T.StructField("infinitive", T.StringType())])


def marked_replies(reply: Column) -> Column:
    """Map of number to text of a reply parted by ``@@@N@@@`` lines; a repeated number keeps its
    last text, a reply without marker gives NULL."""
    parts = F.split(reply, r"(?m)^(?=@@@\d+@@@[ \t]*$)")
    held = F.filter(parts, lambda p: p.rlike(r"^@@@\d+@@@[ \t]*(?:\n|$)"))
    rows = F.transform(held, lambda p, i: F.struct(F.regexp_extract(p, r"^@@@(\d+)@@@", 1).cast("int").alias("k"), i.alias("i"), strip(F.regexp_replace(p, r"^@@@\d+@@@[ \t]*\n?", "")).alias("v")))
    last = F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["k"] == r["k"]) & (o["i"] > r["i"])))
    return F.when(F.size(held) > 0, F.map_from_entries(F.transform(last, lambda r: F.struct(r["k"], r["v"]))))


def _form(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def unit_lines(block: Column) -> Column:
    """Units of a reply's lines ``surface ¦ pos ¦ gloss ¦ inf=...``; an infinitive that only
    echoes its surface is blank, lines of fewer than three fields are none."""

    def unit(line: Column) -> Column:
        parts = F.transform(F.split(line, "¦"), strip)
        extra = F.filter(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), lambda x: x.rlike(r"^inf\s*="))
        inf = F.coalesce(strip(F.regexp_replace(F.try_element_at(extra, F.lit(-1)), r"^inf\s*=", "")), F.lit(""))
        surface = F.element_at(parts, 1)
        return F.struct(surface.alias("surface"), F.element_at(parts, 2).alias("pos"), F.element_at(parts, 3).alias("gloss"), F.when((inf != "") & (_form(inf) == _form(surface)), "").otherwise(inf).alias("infinitive"))

    good = F.filter(F.split(block, "\r?\n"), lambda x: (F.size(F.split(x, "¦")) >= 3) & (strip(F.element_at(F.split(x, "¦"), 1)) != ""))
    return F.transform(good, unit)


def anchor_units(text: str, units: list[dict]) -> list[dict] | None:
    """Spans of the units in the text, found in order under one typography; None if one is missing or none is left."""
    folded, offsets = typography_fold(text)
    spans, at = [], 0
    for u in units:
        surface = typography_fold(u["surface"] or "")[0].strip()
        if not surface:
            continue
        found = folded.find(surface, at)
        if found < 0:
            return None
        at = found + len(surface)
        spans.append({"start": offsets[found], "end": offsets[at - 1] + 1, "pos": u["pos"], "gloss": u["gloss"], "infinitive": u["infinitive"]})
    return spans or None


@F.pandas_udf(T.ArrayType(SPAN))
def anchor(texts: pd.Series, units: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or u is None else anchor_units(t, [dict(x) if isinstance(x, dict) else x.asDict() for x in u]) for t, u in zip(texts, units)], dtype=object)


def surface_words(surface: Column) -> Column:
    return F.regexp_extract_all(F.lower(surface), F.lit(r"[\p{L}]+"), F.lit(0))


def content_words(surface: Column, function_words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    return F.filter(surface_words(surface), lambda w: ~w.isin(*function_words))


def parted_by(surface: Column, markers: tuple[str, ...], function_words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Whether a marker word stands between two content words: a fold over the words."""
    start = F.struct(F.lit(False).alias("seen"), F.lit(False).alias("joined"), F.lit(False).alias("parted"))

    def step(a: Column, w: Column) -> Column:
        mark = w.isin(*markers) & a["seen"]
        content = ~mark & ~w.isin(*function_words)
        return F.struct((a["seen"] | content).alias("seen"), (a["joined"] | mark).alias("joined"), (a["parted"] | (content & a["joined"])).alias("parted"))

    return F.aggregate(surface_words(surface), start, step, lambda a: a["parted"])


def too_wide(surface: Column, pos: Column, function_words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Whether a unit explains more than one thing: parts joined by a word, or over two content words (one if it predicates)."""
    limit = F.when(pos.rlike("(?i)verb|clause|sentence"), 1).otherwise(2)
    return parted_by(surface, COORDINATORS, function_words) | parted_by(surface, PREPOSITIONS, function_words) | (F.size(content_words(surface, function_words)) > limit)


def displayable(text: Column, units: Column, function_words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Units narrow enough to show, judged when read and never when stored."""
    surface = lambda u: F.substring(text, u["start"] + 1, u["end"] - u["start"])
    return F.filter(units, lambda u: ~too_wide(surface(u), u["pos"], function_words))


def gloss_coverage(text: Column, units: Column) -> Column:
    """Share of the non-space characters that lie inside units; 1 for a text without any."""
    bare = lambda t: F.length(F.regexp_replace(t, r"[\s\p{Z}]+", ""))
    inside = F.aggregate(units, F.lit(0), lambda n, u: n + bare(F.substring(text, u["start"] + 1, u["end"] - u["start"])))
    return F.when(bare(text) == 0, 1.0).otherwise(F.coalesce(inside, F.lit(0)) / bare(text))


def gloss_key(h: Column, prompt: Column) -> Column:
    """A cache key that changes with the rules: the hash and eight digits of the prompt's."""
    return F.concat_ws(".", h, F.left(F.sha2(prompt, 256), F.lit(8)))


def absorb(held: DataFrame, replies: DataFrame) -> DataFrame:
    """Units held by key with replies added, in whatever order they come: the same reply again
    changes nothing, a failure ('[]') never displaces units, and a later success displaces a failure."""
    both = held.select("h", "units", F.lit(1).alias("old")).unionByName(replies.select("h", "units", F.lit(0).alias("old")))
    rank = F.struct((F.size("units") > 0).alias("good"), "old", F.to_json("units").alias("j"), "units")
    return both.groupBy("h").agg(F.max(rank).alias("m")).select("h", "m.units")


def rescue(failed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units of paragraphs (h) put together from their chunks' units with the chunks' offsets added."""
    moved = chunks.select("h", "offset", F.transform("units", lambda u: F.struct((u["start"] + F.col("offset")).alias("start"), (u["end"] + F.col("offset")).alias("end"), u["pos"].alias("pos"), u["gloss"].alias("gloss"), u["infinitive"].alias("infinitive"))).alias("units"))
    per = moved.join(failed.select("h"), "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("offset", "units"))).alias("a"))
    return per.select("h", F.flatten("a.units").alias("units"))


def protocol(prompt: str, function_words: tuple[str, ...] = FUNCTION_WORDS) -> dict:
    """The rules as data, for a reader that annotates on its own."""
    return {"prompt": prompt, "field": "¦", "functionWords": list(function_words), "coordinators": list(COORDINATORS), "prepositions": list(PREPOSITIONS)}
