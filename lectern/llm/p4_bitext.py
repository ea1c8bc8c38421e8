"""Sentence alignment in bilingual documents.

Method: word tables are learned from the corpus itself (co-occurrence over sentence pairs
that share rare names or numbers, then over the first matches). Sentences become weighted
bags in the other language, retrieved in both directions through inverted indexes of the
paired chapters; pairs that are each other's best match stand, and merges grow around them:
a further pair needs words that neither of its sentences' matches explains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import chapter_number
from lectern.session import small, table, written

#: Weights are log(sentences / sentences with the word): words of over a ninth of the sentences carry none.
MIN_WEIGHT, NAME_WEIGHT = 2.2, 3.5
MIN_JOINT, MIN_LIFT, MIN_SHARE = 3, 4.0, 0.1
MATCH, GROW_SCORE, GROW_WEIGHT, FAR_WEIGHT, SURE_SCORE, SURE_WEIGHT, NEAR = 0.35, 0.38, 9.5, 14.0, 0.75, 5.0, 4


def paired_chapters(reports: DataFrame, chapters: DataFrame) -> DataFrame:
    """(fr_chapter, en_chapter): numbered chapters of paired editions.

    By part and number; where only one edition of a pair has parts, by the order of the
    numbered chapters. A repeated number pairs at its first chapter; NULL parts are equal.
    """
    pairs = reports.select(F.col("fr_edition_id").alias("fr"), F.col("en_edition_id").alias("en")).filter("fr is not null and en is not null").distinct()
    n = chapters.select("edition_id", "chapter_id", "ch_idx", "part_no", chapter_number(F.col("number_token")).alias("n")).filter("n is not null and edition_id is not null")
    n = n.groupBy("edition_id", "part_no", "n").agg(F.min(F.struct("ch_idx", "chapter_id")).alias("c")).select("edition_id", "part_no", "n", "c.ch_idx", "c.chapter_id")
    whole = Window.partitionBy("edition_id")
    n = n.withColumns({"rank": F.row_number().over(whole.orderBy("ch_idx", "chapter_id")), "parts": F.max(F.col("part_no").isNotNull()).over(whole)})
    fr = n.select(F.col("edition_id").alias("fr"), F.col("part_no").alias("fp"), F.col("n").alias("fn"), F.col("rank").alias("fk"), F.col("parts").alias("fparts"), F.col("chapter_id").alias("fr_chapter"))
    en = n.select(F.col("edition_id").alias("en"), F.col("part_no").alias("ep"), F.col("n").alias("en_n"), F.col("rank").alias("ek"), F.col("parts").alias("eparts"), F.col("chapter_id").alias("en_chapter"))
    both = pairs.join(fr, "fr").join(en, "en")
    same = (F.col("fparts") == F.col("eparts")) & F.col("fp").eqNullSafe(F.col("ep")) & (F.col("fn") == F.col("en_n"))
    return both.filter(same | ((F.col("fparts") != F.col("eparts")) & (F.col("fk") == F.col("ek")))).select("fr", "en", "fr_chapter", "en_chapter").distinct()


def _weighted(sents: DataFrame) -> DataFrame:
    """(pair, side, sid, pos, bag, t): each sentence's words of weight, hashed, and their sum.

    ``bag`` holds structs (k, w, x, alike, digits): the number in the sentence, the word, its
    weight, whether both languages write it. Written once; words are exploded from it.
    """
    by_side = [F.count_if(F.col("side") == s).alias("d" + s) for s in "fe"]
    words = sents.select("side", F.explode("toks").alias("w")).groupBy("w").agg(*by_side)
    totals = sents.agg(*[F.count_if(F.col("side") == s).alias("n" + s) for s in "fe"])
    idf = words.join(F.broadcast(totals)).select("w", *[F.ln(F.col("n" + s) / F.when(F.col("d" + s) > 0, F.col("d" + s))).cast("float").alias("x" + s) for s in "fe"])
    idf = small(written(idf, "idf"))
    key = ["pair", "side", "sid", "pos"]
    rows = sents.select(*key, F.posexplode("toks").alias("k", "w")).join(idf, "w")
    rows = rows.select(*key, F.col("k").cast("smallint").alias("k"), F.xxhash64("w").alias("w"), F.when(F.col("side") == "f", F.col("xf")).otherwise(F.col("xe")).alias("x"), (F.col("xf").isNotNull() & F.col("xe").isNotNull()).alias("alike"), F.col("w").rlike(r"^\d+$").alias("digits"))
    rows = rows.filter((F.col("x") > MIN_WEIGHT) | F.col("digits"))
    return rows.groupBy(*key).agg(F.collect_list(F.struct("k", "w", "x", "alike", "digits")).alias("bag"), F.sum("x").cast("float").alias("t"))


def _side(bags: DataFrame, side: str) -> DataFrame:
    """The words of one side: columns named for it."""
    one = bags.filter(F.col("side") == side)
    one = one.select("pair", F.col("sid").alias(side), F.col("pos").alias("p" + side), F.col("t").alias("t" + side), "bag").select("*", F.inline("bag")).drop("bag")
    return one.withColumnsRenamed({"k": "k" + side, "w": "w" + side, "x": "x" + side})


def learn(links: DataFrame, bags: DataFrame, glossary: DataFrame) -> DataFrame:
    """(wf, we, forward, backward): which words translate each other, from linked sentences.

    A pair of words counts where it is seen ``MIN_JOINT`` times, ``MIN_LIFT`` times as often as
    by chance, and takes at least ``MIN_SHARE`` of one word's occurrences. Words written alike
    in both languages and the glossary's terms are added.
    """
    f, e = (bags.filter(F.col("side") == s).select(F.col("sid").alias(s), F.array_distinct("bag.w").alias("b" + s)) for s in "fe")
    rows = links.select("f", "e").distinct().join(f, "f").join(e, "e").select("bf", "be")
    rows = written(rows, "linked")
    joint = rows.select(F.explode("bf").alias("wf"), "be").select("wf", F.explode("be").alias("we")).groupBy("wf", "we").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_JOINT)
    nf = rows.select(F.explode("bf").alias("wf")).groupBy("wf").agg(F.count("*").alias("nf"))
    ne = rows.select(F.explode("be").alias("we")).groupBy("we").agg(F.count("*").alias("ne"))
    total = rows.agg(F.count("*").alias("total"))
    seen = joint.join(nf, "wf").join(ne, "we").join(F.broadcast(total))
    seen = seen.filter(F.col("n") * F.col("total") >= MIN_LIFT * F.col("nf") * F.col("ne"))
    out = seen.select("wf", "we", (F.col("n") / F.col("nf") >= MIN_SHARE).alias("forward"), (F.col("n") / F.col("ne") >= MIN_SHARE).alias("backward"))
    alike = bags.select(F.inline("bag")).filter("alike").select(F.col("w").alias("wf"), F.col("w").alias("we")).distinct()
    terms = glossary.filter("term_fr is not null and term_en is not null").select(F.xxhash64(F.lower("term_fr")).alias("wf"), F.xxhash64(F.lower("term_en")).alias("we"))
    sure = alike.unionByName(terms).withColumns({"forward": F.lit(True), "backward": F.lit(True)})
    return out.unionByName(sure).groupBy("wf", "we").agg(F.max("forward").alias("forward"), F.max("backward").alias("backward")).filter("forward or backward")


def _candidates(bags: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(pair, f, pf, e, pe, he, hf, ov, sc): sentence pairs met in the paired chapters' inverted index.

    A French sentence's bag holds the words that either table relates to its own. ``he`` are the
    English words that the forward table explains, ``hf`` the French words that the backward
    table explains: both directions' retrievals, which must agree later.
    """
    f = _side(bags, "f").select("pair", "f", "pf", "tf", "kf", "wf", "xf")
    e = _side(bags, "e").select("pair", "e", "pe", "te", "ke", "we", "xe")
    hits = f.join(small(lexicon), "wf").join(e, ["pair", "we"])
    he, hf = F.struct(F.col("ke").alias("k"), F.col("xe").alias("x")), F.struct(F.col("kf").alias("k"), F.col("xf").alias("x"))
    same = [F.first(c).alias(c) for c in ("pair", "pf", "pe", "tf", "te")]
    met = hits.groupBy("f", "e").agg(*same, F.collect_set(F.when(F.col("forward"), he)).alias("he"), F.collect_set(F.when(F.col("backward"), hf)).alias("hf"))
    met = met.filter((F.size("he") > 1) | (F.size("hf") > 1))
    ov = (_sum("he") + _sum("hf")) / 2
    rows = met.select("pair", "f", "pf", "e", "pe", "he", "hf", ov.alias("ov"), (ov / F.least("tf", "te")).alias("sc"))
    return rows.filter(F.col("sc") >= MATCH)


def _sum(hits: str | Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["x"].cast("double"))


def _mutual(cand: DataFrame) -> DataFrame:
    """Pairs that are each other's best, of either direction's ranking (ties: the lower sentence)."""
    order = [F.desc(F.round("ov", 9)), F.desc(F.round("sc", 9))]
    by_f, by_e = Window.partitionBy("pair", "f").orderBy(*order, "e"), Window.partitionBy("pair", "e").orderBy(*order, "f")
    ranked = cand.withColumns({"rf": F.row_number().over(by_f), "re": F.row_number().over(by_e)})
    return ranked.filter((F.col("rf") == 1) & (F.col("re") == 1) & (F.col("sc") >= MATCH)).drop("rf", "re")


def _grown(cand: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs whose common words neither sentence's own match explains: beside a match few suffice,
    elsewhere (reordered passages) it takes more, or that one sentence lies in the other whole."""
    mf = matched.select("pair", "f", F.col("e").alias("me"), F.col("pe").alias("mpe"), F.col("hf").alias("mhf"))
    me = matched.select("pair", "e", F.col("f").alias("mf"), F.col("pf").alias("mpf"), F.col("he").alias("mhe"))
    rows = cand.join(mf, ["pair", "f"], "left").join(me, ["pair", "e"], "left")
    rows = rows.filter(~F.col("me").eqNullSafe(F.col("e")))
    near = (F.abs(F.col("mpe") - F.col("pe")) <= NEAR) | (F.abs(F.col("mpf") - F.col("pf")) <= NEAR)
    empty = F.array().cast("array<struct<k:smallint,x:float>>")
    left = F.least(_sum(F.array_except("he", F.coalesce("mhe", empty))), _sum(F.array_except("hf", F.coalesce("mhf", empty))))
    rows = rows.filter(F.col("sc") >= GROW_SCORE)
    enough = F.when(F.coalesce(near, F.lit(False)), GROW_WEIGHT).otherwise(FAR_WEIGHT)
    return rows.filter((left >= enough) | ((F.col("sc") >= SURE_SCORE) & (left >= SURE_WEIGHT))).select(*cand.columns)


def align_sentences(sentences: DataFrame, chapters: DataFrame, reports: DataFrame, glossary: DataFrame) -> DataFrame:
    """(fr, en, fr_chapter, en_chapter, f, e): translated sentence pairs of the paired chapters.

    Sentences without id, chapter or text have no pair; empty tables give no rows. One
    sentence may stand in several pairs: merges, splits and editions with several partners.
    """
    pairs = paired_chapters(reports, chapters).withColumn("pair", F.xxhash64("fr_chapter", "en_chapter"))
    pairs = written(pairs, "pairs")
    s = sentences.filter("sent_id is not null and chapter_id is not null and text is not null").select("sent_id", "chapter_id", "p_idx", "s_idx", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("toks"))
    s = s.groupBy("sent_id").agg(F.min(F.struct("chapter_id", "p_idx", "s_idx", "toks")).alias("s")).select("sent_id", "s.*")
    within = Window.partitionBy("chapter_id")
    placed = s.withColumn("pos", F.row_number().over(within.orderBy("p_idx", "s_idx", "sent_id")))
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("fr_chapter").alias("chapter_id")), F.struct(F.lit("e").alias("side"), F.col("en_chapter").alias("chapter_id")))).alias("s")).select("pair", "s.*")
    placed = placed.join(sides, "chapter_id")
    placed = placed.select("pair", "side", F.col("sent_id").alias("sid"), "pos", "toks")
    bags = written(_weighted(written(placed, "placed")), "bags")
    anchor = lambda side: F.expr(f"alike and (digits or x{side} > {NAME_WEIGHT})")
    links = _side(bags, "f").filter(anchor("f")).select("pair", F.col("wf").alias("w"), "f").join(_side(bags, "e").filter(anchor("e")).select("pair", F.col("we").alias("w"), "e"), ["pair", "w"])
    lexicon = written(learn(links, bags, glossary), "lexicon")
    first = written(_mutual(_candidates(bags, lexicon)).select("f", "e"), "matches")
    lexicon = written(learn(first, bags, glossary), "lexicon")
    cand = written(_candidates(bags, lexicon), "candidates")
    matched = written(_mutual(cand), "matches")
    found = matched.select("pair", "f", "e").unionByName(_grown(cand, matched).select("pair", "f", "e"))
    return found.distinct().join(pairs, "pair").select("fr", "en", "fr_chapter", "en_chapter", "f", "e")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    chapters = t("chapter").select("chapter_id", "edition_id", "ch_idx", "number_token", "part_no")
    return align_sentences(t("sentence"), chapters, t("alignment_report"), t("glossary"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences where one translates the other or a part of it."""
    return _aligned(spark, sf_dir).select(F.least("f", "e").alias("sent_a"), F.greatest("f", "e").alias("sent_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each edition pair, recomputed: French sentences in all, matched one to one
    (exact), in merges or splits (grouped), and without counterpart (unmatched)."""
    links = written(_aligned(spark, sf_dir), "links")
    of_f = links.groupBy("fr", "en", "f").agg(F.count("*").alias("nf"))
    of_e = links.groupBy("fr", "en", "e").agg(F.count("*").alias("ne"))
    kinds = links.join(of_f, ["fr", "en", "f"]).join(of_e, ["fr", "en", "e"]).groupBy("fr", "en", "f").agg(F.max(F.greatest("nf", "ne")).alias("m"))
    counts = kinds.groupBy("fr", "en").agg(F.count_if(F.col("m") == 1).alias("exact"), F.count_if(F.col("m") > 1).alias("grouped"))
    chapters = table(spark, sf_dir, "chapter").select("chapter_id", "edition_id", "ch_idx", "number_token", "part_no")
    pairs = paired_chapters(table(spark, sf_dir, "alignment_report"), chapters)
    sent = table(spark, sf_dir, "sentence").filter("text is not null").select("sent_id", F.col("chapter_id").alias("fr_chapter")).distinct()
    totals = pairs.select("fr", "en", "fr_chapter").distinct().join(sent, "fr_chapter").groupBy("fr", "en").agg(F.count("*").alias("total"))
    out = totals.join(counts, ["fr", "en"], "left").na.fill(0, ["exact", "grouped"])
    return out.select(F.col("fr").alias("fr_edition_id"), F.col("en").alias("en_edition_id"), "total", "exact", "grouped", (F.col("total") - F.col("exact") - F.col("grouped")).alias("unmatched"))
