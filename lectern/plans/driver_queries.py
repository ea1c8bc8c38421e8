"""Queries of the compositions: repair, alignment of editions, builds, the embedding cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import content_hash as h
from lectern.operators import drivers as dr
from lectern.plans.align_queries import AGREE, both_sides
from lectern.plans.registry import Registry, book, sql_hash
from lectern.plans.structure_queries import matter
from lectern.plans.structure_queries import reg as structure
from lectern.session import table

reg = Registry()
queries, oracle_sql = lambda: dict(reg.queries), lambda: dict(reg.sql)


@reg.add("r11_repair")
def r11(spark, d):
    """Every chapter's text repaired, with what was done (an order of folds; tested against a plain replay)."""
    texts = book(spark, d, joined="\n").select("doc", "text", (F.col("doc") % 2 == 0).alias("pdf"))
    return dr.repair_texts(texts).select("doc", h(F.col("text")).alias("h"), *dr.REPORT)


@reg.add(
    "j24_align_editions",
    f"""with recursive {AGREE}, pins as (select book, l, r from agree union select a.book, a.l, b.r from (select book, num, min(pos) as l from ls where num is not null group by all) a join (select book, num, min(pos) as r from rs where num is not null group by all) b using (book, num)),
    o as (select book, l, r, row_number() over (partition by book order by l, r) as k from pins),
    piles(book, k, tails) as (select book, 0::bigint, []::bigint[] from (select distinct book from o) union all
      select p.book, p.k + 1, list_concat(p.tails[1:len(list_filter(p.tails, lambda x: x <= o.r))], [o.r], p.tails[len(list_filter(p.tails, lambda x: x <= o.r)) + 2:]) from piles p join o on o.book = p.book and o.k = p.k + 1),
    n as (select book, len(arg_max(tails, k)) as n from piles group by book),
    a as (select book, count(distinct num) as a, count(*) as total from ls group by 1), b as (select book, count(distinct num) as b from rs group by 1)
    select book, total as paragraphs, case when a > 0 and b > 0 then 'numbered' when coalesce(n, 0) >= 4 then 'anchored' else 'proportional' end as method from a join b using (book) left join n using (book)""",
)
def j24(spark, d):
    """How each pair of editions was aligned, with the paragraphs that went through that branch."""
    return dr.align_editions(*both_sides(spark, d)).groupBy("book", "method").agg(F.count("*").alias("paragraphs"))


@reg.add("c2_in_proportion")
def c2(spark, d):
    """English text for each French sentence over the whole book by length alone."""
    return dr.in_proportion(*both_sides(spark, d)).select("book", "pos", h(F.col("value")).alias("h"))


@reg.add("c3_aligned_build")
def c3(spark, d):
    """French books translated by a stand-in and set beside their English edition; counts a book."""
    left, right = (s.select("book", "ch_idx", "num", F.col("pos").alias("p_idx"), "text") for s in both_sides(spark, d))
    pairs, _ = dr.build_reader(left, lambda text, before, value: text.upper(), right)
    return pairs.groupBy("book", "method").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("published") != "").alias("placed"), F.count("translation").alias("translated"))


MATTER_SQL = structure.sql["t1_t3_trim_matter"].replace(f"{sql_hash('text')} as h from e", "text from e")


@reg.add(
    "c1_translate_build",
    f"with body as ({MATTER_SQL}), p as (select *, row_number() over (partition by book order by ch_idx, p_idx) - 1 as pos from body) "
    f"select book, pos, {sql_hash('text')} as h, {sql_hash(chr(39) + chr(39) + ' || coalesce(lag(length(text)) over (partition by book, ch_idx order by pos), 0) || ' + chr(39) + ':' + chr(39) + ' || text')} as translation from p",
)
def c1(spark, d):
    """Books trimmed, gated and translated in order; the stand-in says how long the paragraph before was."""
    pairs, _ = dr.build_reader(matter(spark, d), lambda text, before, value: f"{len(before)}:{text}")
    return pairs.select("book", "pos", "h", h(F.col("translation")).alias("translation"))


@reg.add("e6_embedding_cache", "select sent_id, length(trim(text, ' '))::double as length, (length(text) - length(replace(text, 'e', '')))::double as es from sentence where text is not null")
def e6(spark, d):
    """Vectors of all sentences by content, a third of the contents from a cache that an earlier run left."""
    s = table(spark, d, "sentence").select(F.col("sent_id").alias("id"), "text")
    embed = lambda batch: [[float(len(t)), float(t.count("e"))] for t in batch]
    empty = spark.createDataFrame([], "key string, value string")
    _, held = dr.embed_cached(s.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == 0), embed, empty)
    vectors, _ = dr.embed_cached(s, embed, held)
    return vectors.select(F.col("id").alias("sent_id"), F.element_at("vector", 1).alias("length"), F.element_at("vector", 2).alias("es"))
