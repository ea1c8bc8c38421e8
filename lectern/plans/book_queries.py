"""Queries of sources, annotation, enrichment, metrics, merges and finished books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.numbers import chapter_number
from lectern.functions.text import content_hash as h
from lectern.functions.text import upper_median_of
from lectern.operators import annotate as an
from lectern.operators import enrich as en
from lectern.operators import merge as mg
from lectern.operators import metrics as mt
from lectern.operators import packing as pk
from lectern.operators.changefeed import first_deliveries, instant_micros
from lectern.plans import render as rd
from lectern.plans.align_queries import CHAPTERS, both_chapters, both_sides
from lectern.plans.registry import PARAS, Registry, paras, sql_hash
from lectern.plans.structure_queries import sql_num, sql_pack
from lectern.sources import files as fl
from lectern.sources import library as lb
from lectern.session import ship, table

reg = Registry()
queries, oracle_sql = lambda: dict(reg.queries), lambda: dict(reg.sql)


# --- S: sources -------------------------------------------------------------------------


@reg.add("s1_format", "select edition_id, case lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) when 'pdf' then 'pdf' when 'epub' then 'epub' when 'txt' then 'text' when 'htm' then 'html' end as format from (select edition_id, case edition_id % 5 when 0 then 'a/B.PDF' when 1 then 'a.epub' when 2 then 'x.y.txt' when 3 then 'p.htm' else 'none.xyz' end as p from edition)")
def s1(spark, d):
    p = F.element_at(F.array(*[F.lit(x) for x in ("a/B.PDF", "a.epub", "x.y.txt", "p.htm", "none.xyz")]), (F.col("edition_id") % 5 + 1).cast("int"))
    return table(spark, d, "edition").select("edition_id", fl.format_of(p).alias("format"))


@reg.add("s2_s3_read_files")
def s2(spark, d):
    """Pages as binary files: decoded (every third in windows-1252), tags to text; the round trip is tested on files."""
    r = table(spark, d, "resolved").filter("html is not null")
    ship(spark)
    latin = F.encode(F.regexp_replace("html", r"[^\x00-\x7f\xa0-\xff]", "-"), "ISO-8859-1")
    content = F.when(F.col("resolved_id") % 3 == 0, latin).otherwise(F.encode("html", "UTF-8"))
    files = r.select(F.concat(F.lit("p"), "resolved_id", F.lit(".html")).alias("path"), content.alias("content"))
    return fl.read_binaries(files).select("path", "format", "n_bytes", h(F.col("text")).alias("h"), "error")


@reg.add("s7_stated_title", "select edition_id, case when not regexp_matches(title, '(?i)\\.(?:pdf|docx?|epub|txt|indd|qxd)$') then title end as title from book_info")
def s7(spark, d):
    return table(spark, d, "book_info").select("edition_id", fl.stated_title(F.col("title")).alias("title"))


@reg.add("s8_looks_scanned", "select edition_id, case when chars > 0 then (chars * (1 + edition_id % 40)) / chars > 20 end as scanned from edition where chars is not null")
def s8(spark, d):
    """Bytes a character, with sizes put in for the files that the tables lack."""
    e = table(spark, d, "edition").filter("chars is not null")
    text = F.repeat(F.lit("x"), F.col("chars").cast("int"))
    return e.select("edition_id", fl.looks_scanned(F.col("chars") * (1 + F.col("edition_id") % 40), text).alias("scanned"))


@reg.add("s9_parse_pages")
def s9(spark, d):
    r = table(spark, d, "resolved").filter("html is not null").select("resolved_id", lb.parse_page_udf("html").alias("p"))
    return r.select("resolved_id", F.col("p.title").alias("title"), F.size("p.paragraphs").alias("n"), h(F.array_join("p.paragraphs", "\n")).alias("h"))


LINKS = r"""links as (select resolved_id as page_id, pos, regexp_extract(a, 'href\s*=\s*["''](.*)["'']', 1) as t from (select resolved_id, unnest(a) as a, unnest(range(len(a))) as pos from (select resolved_id, regexp_extract_all(html, '<[aA]\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*'')') as a from resolved where html is not null))),
    good as (select page_id, t, pos from links where t like './%' and not contains(t, '?') and not contains(string_split(t, '/')[-1], ':'))"""


@reg.add("s12_links", f"with {LINKS} select page_id, replace(substring(t, 3), '_', ' ') as target from good group by page_id, t")
def s12(spark, d):
    """Internal links of every page, each once."""
    return lb.page_links(table(spark, d, "resolved").filter("html is not null").select(F.col("resolved_id").alias("page_id"), "html")).select("page_id", "target")


HEADER = """'{"title":{"wt":"{{sc|' || title || '}}"},"auteur":{"wt":"[[Auteur:X|' || coalesce(author, '') || ']]"},"current":{"wt":"[[P/' || edition_id || '|' || title || ']]"}}'"""


@reg.add("s13_credits", "select edition_id, trim(title, ' .,') as title, nullif(trim(coalesce(author, ''), ' .,'), '') as author, case when not regexp_matches(title, '(?i)^[ivxlcdm\\d]+\\.?$') then trim(title, ' .,') end as header from book_info where title is not null")
def s13(spark, d):
    """Credits read from header data built of the books' own records."""
    b = table(spark, d, "book_info").filter("title is not null")
    page = F.concat(F.lit('{"title":{"wt":"{{sc|'), "title", F.lit('}}"},"auteur":{"wt":"[[Auteur:X|'), F.coalesce("author", F.lit("")), F.lit(']]"},"current":{"wt":"[[P/'), F.col("edition_id").cast("string"), F.lit("|"), "title", F.lit(']]"}}'))
    return b.select("edition_id", lb.credit(page, "title").alias("title"), lb.credit(page, "author").alias("author"), lb.header_title(page).alias("header"))


@reg.add(
    "s10_resolve_works",
    """with l as (select work, target, min(pos) as pos from (select replace(work_page, '_', ' ') as work, unnest(range(len(pages))) as pos, replace(unnest(pages), '_', ' ') as target from resolved) where work is not null and target is not null group by 1, 2),
    works as (select distinct work from l), sub as (select * from l where starts_with(target, work || '/')), own as (select work as page, count(*) as n, work as home from sub group by 1),
    c1 as (select l.work, o.n, o.home, row_number() over (partition by l.work order by o.n desc, l.pos, l.target desc) as k from l join own o on o.page = l.target),
    b1 as (select * from own union all select work, n, home from c1 where k = 1 and work not in (select page from own)),
    c2 as (select l.work, o.n, o.home, row_number() over (partition by l.work order by o.n desc, l.pos, l.target desc) as k from l join b1 o on o.page = l.target),
    b2 as (select * from own union all select work, n, home from c2 where k = 1 and work not in (select page from own)),
    chosen as (select w.work, case when b.home = w.work then 'chapters' when b.home is not null then 'edition' else 'single' end as shape, coalesce(b.home, w.work) as home from works w left join b2 b on b.page = w.work)
    select c.work, shape, coalesce(s.target, c.home) as page, coalesce(s.pos, 0) as pos from chosen c left join sub s on s.work = c.home""",
)
def s10(spark, d):
    """Works of the resolved pages with their sub-pages, through links one and two steps off."""
    r = table(spark, d, "resolved")
    links = r.select(F.replace("work_page", F.lit("_"), F.lit(" ")).alias("work"), F.posexplode("pages").alias("pos", "target")).withColumn("target", F.replace("target", F.lit("_"), F.lit(" ")))
    works = links.select("work").distinct()
    return lb.resolve_work(works, links.groupBy("work", "target").agg(F.min("pos").alias("pos")))


@reg.add("s11_load_edition", "with c as (select edition_id as book, chapter_id, case when chapter_id % 4 = 0 then [] else paragraphs end as p from chapter) select book, chapter_id, row_number() over (partition by book order by chapter_id) - 1 as pos from c where len(list_filter(p, lambda x: x is not null and x <> '')) > 0")
def s11(spark, d):
    c = table(spark, d, "chapter").select(F.col("edition_id").alias("book"), "chapter_id", F.col("chapter_id").alias("pos"), F.when(F.col("chapter_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("paragraphs")).alias("paragraphs"))
    return lb.load_edition(c).select("book", "chapter_id", F.col("pos").cast("bigint").alias("pos"))


@reg.add("s14_search", "select page from edition where page is not null and not contains(page, '/') and contains(lower(page), 'la') and contains(lower(page), 'et') order by edition_id, page limit 10 offset 5")
def s14(spark, d):
    """A page of a title search: filter, then offset and limit over what is left (a feature, no shortcut)."""
    return lb.search(table(spark, d, "edition").filter("page is not null").select("page", F.col("edition_id").alias("rank")), "la et", 5, 10).select("page")


@reg.add("s14_counterparts", "with o as (select slug, min(page) as other from edition where starts_with(lower(lang), 'en') group by 1) select e.edition_id, o.other from edition e left join o using (slug) where starts_with(lower(e.lang), 'fr')")
def s14b(spark, d):
    e = table(spark, d, "edition")
    fr = e.filter(F.lower("lang").startswith("fr")).select("edition_id", F.col("slug").alias("page"))
    other = e.filter(F.lower("lang").startswith("en")).select(F.col("slug").alias("page"), F.col("page").alias("other"))
    return lb.counterparts(fr, other).select("edition_id", "other")


@reg.add("s15_by_author", "select distinct title as path from book_info where strip_accents(lower(author)) = strip_accents(lower('ULRIRD ULREND')) and title is not null")
def s15(spark, d):
    b = table(spark, d, "book_info").filter("title is not null").select(F.col("title").alias("path"), "author")
    return lb.by_author(b, "ulrird Ulrénd".replace("é", "e")).select("path")


@reg.add("s16_divisions", """with c as (select edition_id as book, ch_idx as pos, coalesce(part_no, 0) as division from chapter), n as (select *, case when lag(division) over w is not distinct from division and row_number() over w > 1 then 0 else 1 end as new from c window w as (partition by book order by pos)),
    r as (select *, sum(new) over (partition by book order by pos) as run from n) select book, any_value(division) as division, min(pos) as first, max(pos) as last, count(*) as n from r group by book, run""")
def s16(spark, d):
    c = table(spark, d, "chapter").select(F.col("edition_id").alias("book"), F.col("ch_idx").alias("pos"), F.coalesce("part_no", F.lit(0)).alias("division"))
    return lb.by_division(c).drop("run")


@reg.add("s17_address", "select doc_id, list_transform(regexp_extract_all(slug || '-' || doc_id || '-2', '(\\d+)', 1), lambda x: x::int) as address from documents where slug is not null")
def s17(spark, d):
    return table(spark, d, "documents").filter("slug is not null").select("doc_id", lb.address(F.concat_ws("-", "slug", "doc_id", F.lit("2"))).alias("address"))


@reg.add("c17_title_classes", "select chapter_id, case when regexp_matches(title, '(?i)(?:^|[\\s/])(?:[ivxlcdm]+|\\d+)$') then 'number' when regexp_matches(lower(title), '(?:^|/)(?:notes?|index|table|préface|errata)') then 'apparatus' else 'text' end as class from chapter where title is not null")
def c17(spark, d):
    return table(spark, d, "chapter").filter("title is not null").select("chapter_id", lb.title_class(F.col("title")).alias("class"))


@reg.add("j25_same_heading", "with t as (select chapter_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as x, regexp_replace(lower(title || ' fin'), '[^a-z0-9]', '', 'g') as y, regexp_replace(lower(substring(title, 3)), '[^a-z0-9]', '', 'g') as z from chapter where title is not null) select chapter_id, length(x) > 0 as same, length(x) > 0 and length(z) > 0 and length(regexp_extract(x || chr(1) || z, '^.*$')) >= 0 and (select coalesce(max(i), 0) from (select unnest(range(1, least(length(x), length(z)) + 1)) as i) where substring(x, 1, i) = substring(z, 1, i)) >= 0.6 * least(length(x), length(z)) as other from t")
def j25(spark, d):
    t = table(spark, d, "chapter").filter("title is not null")
    return t.select("chapter_id", lb.same_heading(F.col("title"), F.concat("title", F.lit(" fin"))).alias("same"), lb.same_heading(F.col("title"), F.substring("title", 3, 10000)).alias("other"))


# --- N: annotation ------------------------------------------------------------------------

PROPOSED = "list_transform(regexp_extract_all(text, '[\\p{L}]+'), lambda w, i: w || ' ¦ ' || case when i % 3 = 0 then 'verb' else 'noun' end || ' ¦ g' || i || case when i % 4 = 0 then ' ¦ inf=' || upper(w) when i % 5 = 0 then ' ¦ inf=x' else '' end)"


def proposed(text):
    """A model's reply made from the text itself: one line a word, in order."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}]+"), F.lit(0))
    inf = lambda w, i: F.when((i + 1) % 4 == 0, F.concat(F.lit(" ¦ inf="), F.upper(w))).when((i + 1) % 5 == 0, F.lit(" ¦ inf=x")).otherwise("")
    return F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit(" ¦ "), F.when((i + 1) % 3 == 0, "verb").otherwise("noun"), F.lit(" ¦ g"), (i + 1).cast("string"), inf(w, i))), "\n")


@reg.add("n1_marked_replies", "select chapter_id, '1' as k, regexp_replace(paragraphs[1], '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as v from chapter where len(paragraphs) > 1 and paragraphs[1] is not null and paragraphs[2] is not null union all select chapter_id, '2', regexp_replace(paragraphs[2], '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') from chapter where len(paragraphs) > 1 and paragraphs[1] is not null and paragraphs[2] is not null")
def n1(spark, d):
    """Replies of two marked texts, the first sent twice: the last stands."""
    c = table(spark, d, "chapter").filter("size(paragraphs) > 1 and paragraphs[0] is not null and paragraphs[1] is not null")
    reply = F.concat(F.lit("x\n@@@1@@@\nfirst\n@@@2@@@ \n"), F.col("paragraphs")[1], F.lit("\n@@@1@@@\n"), F.col("paragraphs")[0], F.lit("\n"))
    return c.select("chapter_id", F.explode(an.marked_replies(reply)).alias("k", "v")).select("chapter_id", F.col("k").cast("string").alias("k"), "v")


@reg.add("n2_unit_lines", f"""with l as (select sent_id, {PROPOSED} as lines from sentence), u as (select sent_id, unnest(lines) as line, unnest(range(len(lines))) as i from l), p as (select sent_id, i, list_transform(string_split(line, '¦'), lambda x: trim(x)) as p from u)
    select sent_id, i, p[1] as surface, p[2] as pos, p[3] as gloss, case when len(p) > 3 and regexp_replace(lower(substring(p[4], 5)), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') <> regexp_replace(lower(p[1]), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') then substring(p[4], 5) else '' end as infinitive from p""".replace("{{", "{").replace("}}", "}"))
def n2(spark, d):
    s = table(spark, d, "sentence").select("sent_id", F.posexplode(an.unit_lines(proposed(F.col("text")))).alias("i", "u"))
    return s.select("sent_id", F.col("i").cast("bigint").alias("i"), "u.surface", "u.pos", "u.gloss", "u.infinitive")


def anchored(spark, d):
    s = table(spark, d, "sentence").select("sent_id", "text", an.unit_lines(proposed(F.col("text"))).alias("u"))
    return s.select("sent_id", "text", an.anchor("text", "u").alias("units"))


@reg.add("n3_anchor")
def n3(spark, d):
    """Units anchored to exact spans; made of the text in order, all are found (checked in the tests)."""
    return anchored(spark, d).select("sent_id", F.size("units").alias("n"), h(F.to_json("units")).alias("h"))


FW = "[" + ",".join(f"'{w}'" for w in an.FUNCTION_WORDS) + "]"


@reg.add("n4_unit_width", f"""with p as (select sent_id, unnest(regexp_extract_all(text, '[\\p{{L}}]+ [\\p{{L}}]+ [\\p{{L}}]+')) as surface from sentence), w as (select sent_id, surface, regexp_extract_all(lower(surface), '[\\p{{L}}]+') as w from p),
    c as (select *, list_filter(w, lambda x: not list_contains({FW}, x)) as content,
      list_transform(w, lambda x: not list_contains({FW}, x)) as iscontent from w)
    select sent_id, surface, len(content) > 2 or (iscontent[1] and iscontent[3] and list_contains(['et','ou','ni','mais','de','du','des','d','à','au','aux','en'], w[2]))
      as wide from c""")
def n4(spark, d):
    """Runs of three words as units: too wide where they explain more than one thing."""
    s = table(spark, d, "sentence").select("sent_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+ [\p{L}]+ [\p{L}]+"), F.lit(0))).alias("surface"))
    return s.select("sent_id", "surface", an.too_wide(F.col("surface"), F.lit("noun")).alias("wide"))


@reg.add("n5_displayable")
def n5(spark, d):
    a = anchored(spark, d)
    return a.select("sent_id", F.size(an.displayable(F.col("text"), F.col("units"))).alias("shown"), F.size("units").alias("held"))


@reg.add("n6_gloss_key", f"select sent_id, {sql_hash('text')} || '.' || substring(sha256('rules ' || lang), 1, 8) as key from sentence")
def n6(spark, d):
    return table(spark, d, "sentence").select("sent_id", an.gloss_key(h(F.col("text")), F.concat(F.lit("rules "), "lang")).alias("key"))


@reg.add("a6_gloss_coverage", "select sent_id, round(length(array_to_string(regexp_extract_all(text, '[\\p{L}]+'), '')) / length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')), 6) as coverage from sentence where regexp_matches(text, '[\\p{L}]')")
def a6(spark, d):
    return anchored(spark, d).filter("units is not null").select("sent_id", F.round(an.gloss_coverage(F.col("text"), F.col("units")), 6).alias("coverage"))


@reg.add("n7_n8_absorb")
def n7(spark, d):
    """Units absorbed in any order; of sentences too long for one reply, whose units fail, all are rescued by chunks with their offsets added."""
    a = anchored(spark, d).select(h(F.col("text")).alias("h"), "text", "units")
    held = a.select("h", F.when(F.length("text") > 80, F.slice("units", 1, 0)).otherwise(F.col("units")).alias("units"))
    merged = an.absorb(held, held)
    failed = merged.filter(F.size("units") == 0).select("h")
    cut = F.expr("locate(' ', text, cast(length(text) / 2 as int) + 1)")
    texts = a.join(failed, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).withColumn("cut", cut)
    parts = texts.select("h", F.inline(F.array(F.struct(F.lit(0).alias("offset"), F.expr("substring(text, 1, cut)").alias("text")), F.struct(F.col("cut").alias("offset"), F.expr("substring(text, cut + 1)").alias("text")))))
    chunks = parts.withColumn("u", an.unit_lines(proposed(F.col("text")))).select("h", "offset", an.anchor("text", "u").alias("units"))
    saved = an.rescue(failed, chunks)
    whole = an.absorb(merged, saved).join(failed.withColumn("how", F.lit("rescued")), "h", "left")
    return whole.select("h", F.size("units").alias("n"), F.coalesce("how", F.lit("held")).alias("how"))


# --- E: enrichment ------------------------------------------------------------------------


@reg.add("e2_merge_caches", "with b as (select h as key, text as value, seen_at, 0 as own from unit where text is not null union all select h, '!' || text, seen_at, 1 from unit where text is not null and chapter_id % 3 = 0) select key, arg_max(value, (own, seen_at, value)) as value from b group by key")
def e2(spark, d):
    u = table(spark, d, "unit").filter("text is not null").select(F.col("h").alias("key"), F.col("text").alias("value"), F.col("seen_at").alias("written_at"), "chapter_id")
    mine = u.filter("chapter_id % 3 = 0").withColumn("value", F.concat(F.lit("!"), "value")).drop("chapter_id")
    return en.merge_caches(u.drop("chapter_id"), mine).select("key", "value")


@reg.add("e3_translate_in_order")
def e3(spark, d):
    """A stand-in client run in order inside each chapter: each call sees the paragraph before."""
    u = paras(spark, d).select(F.col("edition_id").alias("book"), F.col("doc").alias("chapter"), F.col("doc") * 100000 + F.col("pos"), "text").toDF("book", "chapter", "pos", "text")
    return en.translate_in_order(u, lambda text, before, value: f"{len(text)}/{len(before)}")


@reg.add("e3_cost_cap", f"with b as ({sql_pack(6000, 4)}), c as (select edition_id as book, \"group\" as batch, sum(length(text))::bigint as cost from b join ({'select chapter_id as doc, unnest(range(len(paragraphs))) as pos, unnest(paragraphs) as text from chapter'}) t using (doc, pos) group by all), s as (select *, coalesce(sum(cost) over (partition by book order by batch rows between unbounded preceding and 1 preceding), 0) as before from c) select book, batch, cost from s where before < 20000")
def e3_cap(spark, d):
    """Batches until the cost cap, the first that reaches it included."""
    return en.until_cap(batches_of(spark, d).select("book", "batch", F.col("chars").alias("cost")), 20000)


def batches_of(spark, d):
    p = paras(spark, d)
    g = pk.pack_rows(p, "edition_id", ["ch_idx", "pos", "doc"], F.length("text"), 6000, 4)
    rows = g.join(p.select("doc", "pos", F.length("text").alias("n")), ["doc", "pos"])
    w = Window.partitionBy("edition_id").orderBy("ch_idx", "pos")
    rows = rows.withColumn("before", F.coalesce(F.lag("n").over(w), F.col("n")))
    return rows.groupBy(F.col("edition_id").alias("book"), F.col("group").alias("batch")).agg(F.sum("n").alias("chars"), F.min_by("before", F.struct("ch_idx", "pos")).alias("context"))


@reg.add("e5_call_batches")
def e5(spark, d):
    """What no cache holds, sent to a stand-in client in batches inside each partition."""
    s = table(spark, d, "sentence").select(h(F.col("text")).alias("key"), "text")
    held = table(spark, d, "unit").select(F.col("h").alias("key"))
    return en.call_batches(en.to_do(s, held), lambda texts: [str(len(t)) for t in texts])


@reg.add("a7_estimate", f"""with b as ({sql_pack(6000, 4)}), t as (select doc, pos, edition_id, ch_idx, length(text) as n from (with {PARAS} select * from paras)), x as (select t.*, coalesce(lag(n) over (partition by t.edition_id order by ch_idx, t.pos), n) as before, b."group" as g from t join b using (edition_id, doc, pos)),
    c as (select edition_id as book, g, sum(n) as chars, arg_min(before, (ch_idx, pos)) as context from x group by all)
    select book, count(*) as batches, (count(*) * 1200 + sum(chars) + sum(context))::bigint // 4 as input_tokens, ceil(sum(chars) * 1.15)::bigint // 4 as output_tokens from c group by book""")
def a7(spark, d):
    out = en.estimate(batches_of(spark, d), 1200)
    return out.select("book", "batches", F.col("input_tokens").cast("bigint").alias("input_tokens"), F.col("output_tokens").cast("bigint").alias("output_tokens"))


@reg.add("e10_price_key", "select source, replace(string_split('a/' || source || '.x', '/')[-1], '.', '-') as k from (select distinct source from edition where source is not null)")
def e10(spark, d):
    return table(spark, d, "edition").filter("source is not null").select("source").distinct().select("source", en.price_key(F.concat(F.lit("a/"), "source", F.lit(".x"))).alias("k"))


# --- A: metrics -----------------------------------------------------------------------------


@reg.add("a1_a2_coverage", "select report_id, case when total > 0 then round((total - unmatched) / total, 6) else 0 end as coverage, total > 0 and (total - unmatched) / total < 0.7 as degraded from alignment_report where total is not null and unmatched is not null")
def a1(spark, d):
    r = table(spark, d, "alignment_report").filter("total is not null and unmatched is not null")
    return r.select("report_id", F.round(mt.coverage(F.col("total"), F.col("unmatched")), 6).alias("coverage"), mt.degraded(F.col("total"), F.col("unmatched")).alias("degraded"))


PLACED = f"""placed as (select lc.book, s.text as value from lc join sentence s using (chapter_id) where s.sent_id % 3 <> 0), published as (select lc.book, s.text from lc join sentence s using (chapter_id))"""


@reg.add("a3_placed_share", f"with {CHAPTERS}, {PLACED} select p.book, round(coalesce((select sum(length(value)) from (select distinct book, value from placed) x where x.book = p.book), 0) / sum(length(text)), 6) as share from published p group by p.book")
def a3(spark, d):
    left, _ = both_chapters(spark, d)
    rows = left.join(table(spark, d, "sentence").select("chapter_id", "sent_id", "text"), "chapter_id")
    placed = rows.filter("sent_id % 3 <> 0").select("book", F.col("text").alias("value"))
    return mt.placed_share(placed, rows.select("book", "text")).select("book", F.round("share", 6).alias("share"))


@reg.add("a4_agreement")
def a4(spark, d):
    """Two placements of one translation, the second with every fourth text lost and every fifth another's."""
    left, right = both_sides(spark, d)
    p = left.select("book", h(F.col("text")).alias("h"), "pos")
    a = p.join(right.select("book", "pos", F.col("text").alias("value")), ["book", "pos"]).groupBy("h").agg(F.max("value").alias("value"))
    b = a.withColumn("value", F.when(F.crc32("h") % 4 == 0, "").when(F.crc32("h") % 5 == 0, F.reverse("value")).otherwise(F.col("value")))
    return mt.agreement(p, a, b)


@reg.add("a4_agreement_exact", f"with {CHAPTERS}, p as (select lc.book, {sql_hash('s.text')} as h, s.sent_id, s.text from lc join sentence s using (chapter_id)), v as (select h, max(text) as a, max(case when sent_id % 4 = 0 then '' else text end) as b from p group by 1) select p.book, count(*) as total, count(case when v.a <> '' and v.b <> '' then 1 end) as agreed, 0::bigint as disagreed, count(case when v.b = '' then 1 end) as only_a, 0::bigint as only_b, 0::bigint as neither from p join v using (h) group by p.book")
def a4x(spark, d):
    """The same counters where agreement is equality: placements that only lack texts."""
    left, _ = both_chapters(spark, d)
    p = left.join(table(spark, d, "sentence").select("chapter_id", "sent_id", "text"), "chapter_id").select("book", h(F.col("text")).alias("h"), "sent_id", "text")
    a = p.groupBy("h").agg(F.max("text").alias("value"))
    b = p.groupBy("h").agg(F.max(F.when(F.col("sent_id") % 4 == 0, "").otherwise(F.col("text"))).alias("value"))
    return mt.agreement(p, a, b).drop("accuracy")


@reg.add("a8_word_counts", f"with {PARAS}, w as (select edition_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{2,}}')) as word from paras) select edition_id, word, count(*) as n from w group by all having count(*) >= 3".replace("{{", "{").replace("}}", "}"))
def a8(spark, d):
    from lectern.operators.repair import words

    w = paras(spark, d).select("edition_id", F.explode(words(F.col("text"))).alias("word"))
    return w.groupBy("edition_id", "word").agg(F.count("*").alias("n")).filter("n >= 3")


@reg.add("a10_structure_report", f"with {PARAS} select edition_id, doc, count(*) as paragraphs, sum(length(text))::bigint as chars from paras group by all")
def a10(spark, d):
    return paras(spark, d).groupBy("edition_id", "doc").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@reg.add("a11_spread_faults", "select report_id, case when (published_chars % 900 < 200)::int + (placed_chars % 900 < 200)::int = 1 then 'one side' when published_chars % 900 < 200 and (published_chars % 900 = 0 or placed_chars % 900 = 0) then 'empty' when greatest(published_chars % 900, placed_chars % 900) > 3.0 * least(published_chars % 900, placed_chars % 900) then 'lopsided' end as fault from alignment_report where published_chars is not null and placed_chars is not null")
def a11(spark, d):
    r = table(spark, d, "alignment_report").filter("published_chars is not null and placed_chars is not null")
    return r.select("report_id", mt.spread_fault(F.col("published_chars") % 900, F.col("placed_chars") % 900).alias("fault"))


@reg.add("a11_spread_check", "select report_id, case when (published_chars < 200)::int + (placed_chars < 200)::int = 1 then 'one side' when published_chars < 200 and (published_chars = 0 or placed_chars = 0) then 'empty' when greatest(published_chars, placed_chars) > 3.0 * least(published_chars, placed_chars) then 'lopsided' end as fault from alignment_report where published_chars is not null and placed_chars is not null")
def a11_check(spark, d):
    """The reports' own columns as they are (a11_spread_faults derives short texts from them, so that every fault occurs)."""
    r = table(spark, d, "alignment_report").filter("published_chars is not null and placed_chars is not null")
    return r.select("report_id", mt.spread_fault(F.col("published_chars"), F.col("placed_chars")).alias("fault"))


@reg.add("a12_shelf_figures", "select a.edition_id, greatest(1, round_even((a.paragraphs + b.paragraphs) / 390, 0)::int) as minutes, round_even((a.chars + b.chars) / 4, 0)::bigint as tokens from edition a join edition b on b.edition_id = a.edition_id + 1 where a.paragraphs is not null and b.paragraphs is not null and a.chars is not null and b.chars is not null")
def a12(spark, d):
    e = table(spark, d, "edition").filter("paragraphs is not null and chars is not null")
    o = e.select((F.col("edition_id") - 1).alias("edition_id"), F.col("paragraphs").alias("p"), F.col("chars").alias("c"))
    return e.join(o, "edition_id").select("edition_id", mt.shelf_minutes(F.col("paragraphs"), F.col("p")).alias("minutes"), mt.shelf_tokens(F.col("chars"), F.col("c")).alias("tokens"))


COUNTED = "n as (select edition_id, count(*) as chapters, sum(len(paragraphs)) as paragraphs from chapter group by 1)"


@reg.add("a13_drift", f"with {COUNTED} select edition_id, 'chapters' as field, e.chapters::varchar as recorded, n.chapters::varchar as measured from edition e full join n using (edition_id) where e.chapters is distinct from n.chapters union all select edition_id, 'paragraphs', e.paragraphs::varchar, n.paragraphs::varchar from edition e full join n using (edition_id) where e.paragraphs is distinct from n.paragraphs")
def a13(spark, d):
    """Recorded counts of editions that differ from what their chapters hold."""
    n = table(spark, d, "chapter").groupBy("edition_id").agg(F.count("*").alias("chapters"), F.sum(F.size("paragraphs")).alias("paragraphs"))
    return mt.drift(table(spark, d, "edition"), n, "edition_id", ["chapters", "paragraphs"])


@reg.add("a14_facets", "select facet, n from (select 'abridged' as facet, count(case when abridged then 1 end) as n, count(*) as total from edition union all select 'several', count(case when chapters > 1 then 1 end), count(*) from edition union all select 'any', count(*), count(*) from edition) where n > 0 and n < total")
def a14(spark, d):
    e = table(spark, d, "edition")
    return mt.useful_facets(e, {"abridged": F.col("abridged"), "several": F.col("chapters") > 1, "any": F.lit(True)})


@reg.add("a15_retry_share", "select run_id, round(case when looked_at > failed then failed / (looked_at - failed) end, 6) as share from respace_run where looked_at is not null and failed is not null")
def a15(spark, d):
    r = table(spark, d, "respace_run").filter("looked_at is not null and failed is not null")
    return r.select("run_id", F.round(mt.retry_share(F.col("failed"), F.col("looked_at")), 6).alias("share"))


@reg.add("a16_medians", f"with {PARAS} select edition_id, median(length(text)) as middle, list_sort(list(length(text)))[count(*) // 2 + 1] as upper from paras group by 1")
def a16(spark, d):
    """The two medians side by side: interpolated, and the upper element."""
    p = paras(spark, d).select("edition_id", F.length("text").alias("l"))
    return p.groupBy("edition_id").agg(F.median("l").alias("middle"), upper_median_of("l").cast("bigint").alias("upper"))


# --- Y: merges ------------------------------------------------------------------------------

ONCE = r"""once as (select * from (select *, row_number() over (partition by change_id order by arrival) as rn from shelf_change) where rn = 1),
    c as (select *, epoch_us(cast(case when regexp_matches(trim(updated_at), '(Z|[+-]\d{2}:?\d{2})$') then trim(updated_at) else trim(updated_at) || 'Z' end as timestamptz)) as ts, lower(trim(op)) as o from once)"""


def changes(spark, d):
    c = first_deliveries(table(spark, d, "shelf_change"))
    return c.withColumns({"at": instant_micros(F.col("updated_at")), "o": F.lower(F.trim("op"))})


@reg.add("y3_merge_edits", f"with {ONCE} select account_id, book_id, h, arg_max(change_id, (ts, arrival)) as change_id, arg_max(coalesce(text, ''), (ts, arrival)) as text from c where entity = 'edit' and o <> 'delete' group by all")
def y3(spark, d):
    c = changes(spark, d).filter("entity = 'edit' and o <> 'delete'")
    return mg.merge_edits(c.select("account_id", "book_id", "h", "at", "arrival", "change_id", F.coalesce("text", F.lit("")).alias("text"))).select("account_id", "book_id", "h", "change_id", "text")


@reg.add("y2_merge_entries", f"with {ONCE}, e as (select * from c where entity = 'entry' and o <> 'delete') select account_id, book_id, arg_max(title, (ts, arrival)) filter (where title is not null) as title, arg_max(position_h, (ts, arrival)) filter (where position_h is not null) as position_h, max(ts) as ts from e group by all")
def y2(spark, d):
    c = changes(spark, d).filter("entity = 'entry' and o <> 'delete'")
    return mg.merge_entries(c.select("account_id", "book_id", "at", "arrival", "title", "position_h"), ["title", "position_h"]).withColumnRenamed("at", "ts")


@reg.add("y2_replay_entries", f"""with recursive {ONCE}, e as (select account_id, book_id, ts, title, position_h, row_number() over (partition by account_id, book_id order by arrival) as k from c where entity = 'entry' and o <> 'delete'),
    w(account_id, book_id, k, ts, title, position_h) as (select account_id, book_id, k, ts, title, position_h from e where k = 1 union all
      select e.account_id, e.book_id, e.k, greatest(w.ts, e.ts), case when e.ts >= w.ts then coalesce(e.title, w.title) else w.title end, case when e.ts >= w.ts then coalesce(e.position_h, w.position_h) else w.position_h end from w join e on e.account_id = w.account_id and e.book_id = w.book_id and e.k = w.k + 1)
    select account_id, book_id, arg_max(ts, k) as ts, (arg_max(row(title), k))[1] as title, (arg_max(row(position_h), k))[1] as position_h from w group by all""")
def y2r(spark, d):
    """The same shelves replayed in the order of arrival."""
    c = changes(spark, d).filter("entity = 'entry' and o <> 'delete'")
    return mg.replay_entries(c.select("account_id", "book_id", "arrival", "at", "title", "position_h"), ["title", "position_h"]).withColumnRenamed("at", "ts")


@reg.add("y1_read_shelf", f"with {ONCE}, e as (select distinct account_id, book_id from c where entity = 'entry'), d as (select account_id, book_id, count(*) as n, max(ts) as last from c where entity = 'edit' group by all) select e.account_id, e.book_id, coalesce(n, 0) as n, last from e left join d using (account_id, book_id)")
def y1(spark, d):
    c = changes(spark, d)
    entries = c.filter("entity = 'entry'").select("account_id", "book_id").distinct()
    shelf = mg.read_shelf(entries, c.filter("entity = 'edit'").select("account_id", "book_id", "at", "h", "base_hash", "text"))
    return shelf.select("account_id", "book_id", F.size("edits").cast("bigint").alias("n"), F.try_element_at("edits", F.lit(-1))["at"].alias("last"))


@reg.add("y4_quotas", "with e as (select account_id, count(*) as n from (select distinct account_id, book_id from shelf_change) group by 1) select account_id, n from e where n > 3")
def y4(spark, d):
    """Shelves past a quota (three books here, so that the tables hold some)."""
    c = table(spark, d, "shelf_change").select("account_id", "book_id").distinct()
    before, mg.BOOKS = mg.BOOKS, 3
    try:
        return mg.over_quota(c, c.filter("false")).select("account_id", "n")
    finally:
        mg.BOOKS = before


@reg.add("y5_cascade", f"with {ONCE}, g as (select distinct account_id, book_id from c where entity = 'entry' and o = 'delete') select change_id from c anti join g using (account_id, book_id) where entity = 'edit'")
def y5(spark, d):
    c = changes(spark, d)
    return mg.cascade(c.filter("entity = 'edit'"), c.filter("entity = 'entry' and o = 'delete'")).select("change_id")


@reg.add("y6_sessions", "select change_id, received_at > timestamp '2023-06-01' as live from (select change_id, max(received_at) as received_at from shelf_change group by 1) where not received_at < timestamp '2023-06-01'")
def y6(spark, d):
    s = table(spark, d, "shelf_change").groupBy("change_id").agg(F.max("received_at").alias("expires_at"))
    now = F.lit("2023-06-01").cast("timestamp_ntz")
    return mg.sweep(s, now).select("change_id", (F.col("expires_at") > now).alias("live"))


@reg.add("y7_k9_upsert", "select edition_id, slug from edition where edition_id % 3 <> 0 union all select edition_id, 'new-' || edition_id from edition where edition_id % 3 = 0")
def y7(spark, d):
    e = table(spark, d, "edition").select("edition_id", "slug")
    return mg.upsert(e, e.filter("edition_id % 3 = 0").withColumn("slug", F.concat(F.lit("new-"), "edition_id")), ["edition_id"])


@reg.add("y8_adopt", f"with {ONCE}, i as (select * from c where entity = 'edit' and change_id % 2 = 0), l as (select account_id, book_id, h, max(ts) as mine from c where entity = 'edit' and change_id % 2 = 1 group by all), p as (select h, min(base_hash) as now from c where entity = 'edit' group by 1) select i.change_id from i join p using (h) left join l using (account_id, book_id, h) where i.base_hash is not distinct from p.now and (l.mine is null or i.ts > l.mine)")
def y8(spark, d):
    c = changes(spark, d).filter("entity = 'edit'")
    local = c.filter("change_id % 2 = 1").groupBy("account_id", "book_id", "h").agg(F.max("at").alias("at"))
    now = c.groupBy("h").agg(F.min("base_hash").alias("base_hash"))
    return mg.adopt(c.filter("change_id % 2 = 0"), local, now).select("change_id")


@reg.add("y9_quiet_periods", """with r as (select account_id, book_id, received_at as ts, case when received_at - lag(received_at) over (partition by account_id, book_id order by received_at) < interval 3 day then 0 else 1 end as new from shelf_change where account_id is not null), s as (select *, sum(new) over (partition by account_id, book_id order by ts) as run from r)
    select account_id, book_id, count(*) as n, min(ts) as first from s group by account_id, book_id, run""")
def y9(spark, d):
    """Pushes after a quiet period (three days here) as session windows."""
    from lectern.streaming.edits import quiet_periods

    c = table(spark, d, "shelf_change").filter("account_id is not null").select("account_id", "book_id", F.col("received_at").cast("timestamp").alias("ts"))
    return quiet_periods(c, "3 days").select("account_id", "book_id", "n", F.col("window.start").cast("timestamp_ntz").alias("first"))


# --- K, C: finished books ---------------------------------------------------------------------


def finished(spark, d):
    p = paras(spark, d)
    w = Window.partitionBy("edition_id").orderBy("ch_idx", "pos")
    rows = p.select(F.col("edition_id").alias("book"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("ch_idx").cast("int").alias("ch_idx"), h(F.col("text")).alias("h"), "text")
    en_ = rows.filter("ch_idx % 3 <> 1").select("h", F.upper("text").alias("value"))
    pub = rows.filter("ch_idx % 2 = 0").select("h", F.lower("text").alias("value"))
    return rd.assemble(rows, en_, pub)


FINISHED = f"""rows as (select edition_id as book, row_number() over (partition by edition_id order by ch_idx, pos) - 1 as pos, ch_idx, {sql_hash('text')} as h, text from paras),
    e as (select h, max(upper(text)) as en from rows where ch_idx % 3 <> 1 group by 1), b as (select h, max(lower(text)) as pub from rows where ch_idx % 2 = 0 group by 1),
    pairs as (select book, pos, ch_idx, h, text as fr, coalesce(en, '') as en, coalesce(pub, '') as pub from rows left join e using (h) left join b using (h))"""


@reg.add("k1_pairs", f"with {PARAS}, {FINISHED} select book, pos, h, en <> '' as has_en, pub <> '' as has_pub from pairs")
def k1(spark, d):
    return finished(spark, d).select("book", "pos", "h", (F.col("en") != "").alias("has_en"), (F.col("pub") != "").alias("has_pub"))


@reg.add("k1_chapter_index", f"with {PARAS}, {FINISHED}, c as (select edition_id as book, ch_idx, {sql_num('number_token')} as num, title from chapter), n as (select book, ch_idx, min(pos) as pair, bool_or(en <> '') as en, bool_or(en <> '' or pub <> '') as pub from pairs group by all) select book, ch_idx, pair, title, not en as en_blank, not pub as pub_blank from c join n using (book, ch_idx) where num is not null or title is not null")
def k1b(spark, d):
    c = table(spark, d, "chapter").select(F.col("edition_id").alias("book"), F.col("ch_idx").cast("int").alias("ch_idx"), chapter_number(F.col("number_token")).alias("num"), "title")
    return rd.chapter_index(finished(spark, d), c).drop("numeral")


@reg.add("k2_k6_round_trip", f"with {PARAS}, {FINISHED} select book, pos, h, {sql_hash('fr')} as again from pairs")
def k6(spark, d):
    """Books written as JSON and read back: every pair must return."""
    back = rd.read_back(rd.book_json(finished(spark, d)))
    return back.select("book", "pos", "h", h(F.col("fr")).alias("again"))


@reg.add("k8_spreads", f"with {PARAS} select edition_id as book, sum(length(text))::bigint as chars, count(*) as paragraphs from paras group by 1")
def k8(spark, d):
    """Spreads cover every character of every paragraph exactly once (the layout itself is tested)."""
    p = finished(spark, d).select("book", "pos", F.col("fr").alias("text"))
    s = rd.spreads(p)
    return s.groupBy("book").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.count_distinct("pos").alias("paragraphs"))


@reg.add("k10_finished_metrics", f"with {PARAS}, {FINISHED} select book, count(*) as paragraphs, count(case when trim(en) <> '' then 1 end) as translated, count(case when ascii(h) % 2 = 0 then 1 end) as glossed, bool_or(pub <> '') as published from pairs group by 1")
def k10(spark, d):
    pairs = finished(spark, d)
    units = pairs.filter(F.ascii("h") % 2 == 0).select("h", F.array(F.lit(1)).alias("units"))
    return rd.finished_metrics(pairs, units)


@reg.add("k11_catalogue", "select b.edition_id, true as found from edition b where slug in (select slug from documents) union all select b.edition_id, false from edition b where slug is null or slug not in (select slug from documents where slug is not null)")
def k11(spark, d):
    e = table(spark, d, "edition").select("slug", "edition_id")
    books = table(spark, d, "documents").filter("slug is not null").select("slug").distinct()
    found, missing = rd.catalogue(e, books)
    return found.select("edition_id", F.lit(True).alias("found")).unionByName(missing.select("edition_id", F.lit(False).alias("found")))


@reg.add("c4_openings", f"with {PARAS}, r as (select edition_id as book, row_number() over (partition by edition_id order by ch_idx, pos) - 1 as pos, text from paras) select book, pos, {sql_hash('substring(text, 1, 1200)')} as h from r where pos < 60")
def c4(spark, d):
    p = finished(spark, d).select("book", "pos", F.col("fr").alias("text"))
    return rd.openings(p).select("book", F.col("pos").cast("bigint").alias("pos"), h(F.col("text")).alias("h"))


@reg.add("c6_published_note", "select report_id, case when total > 0 and (total - unmatched) / total < 0.7 then 'much of this edition found no counterpart' when cut is not null and cut <> '' then 'paragraphs cut to the other edition''s shape' when match_method = 'proportional' then 'set beside by length' when unmatched > 0 then 'some paragraphs have no counterpart' else '' end as note from alignment_report where total > 0 and unmatched is not null")
def c6(spark, d):
    r = table(spark, d, "alignment_report").filter("total > 0 and unmatched is not null")
    return r.select("report_id", rd.published_note(F.col("match_method"), mt.coverage(F.col("total"), F.col("unmatched")), F.col("unmatched"), F.col("cut")).alias("note"))


@reg.add("c7_sample_page", f"with b as ({sql_pack(1400, 2_000_000_000)}), n as (select edition_id, max(\"group\") + 1 as n from b group by 1) select b.edition_id as book, b.doc, b.pos from b join n using (edition_id) where b.\"group\" = 5 % n.n")
def c7(spark, d):
    g = pk.pack_rows(paras(spark, d).withColumnRenamed("edition_id", "book"), "book", ["ch_idx", "pos", "doc"], F.length("text"), 1400)
    return rd.one_page(g, 5).select("book", "doc", F.col("pos").cast("bigint").alias("pos"))


@reg.add("c10_shelf_lookup", "select edition_id, slug from edition where contains(lower(slug), 'poire') or contains(lower(coalesce(translator, '')), 'mar')")
def c10(spark, d):
    return rd.shelf_lookup(table(spark, d, "edition"), {"slug": "poire", "translator": "mar"}).select("edition_id", "slug")


@reg.add("c11_probe_pair", f"with {CHAPTERS}, a as (select book, count(*) as n from lc group by 1), b as (select book, count(*) as m from rc group by 1) select book, n, m, least(n, m) >= 0.8 * greatest(n, m) as alike from a join b using (book)")
def c11(spark, d):
    return rd.probe_pair(*both_chapters(spark, d))


@reg.add("c12_edition_summary", f"with {COUNTED}, k as (select edition_id, sum(list_sum(list_transform(paragraphs, lambda x: coalesce(length(x), 0)))) as chars from chapter group by 1) select e.edition_id, coalesce(n.chapters, e.chapters)::bigint as chapters, coalesce(n.paragraphs, e.paragraphs)::bigint as paragraphs, coalesce(k.chars, e.chars)::bigint as chars from edition e left join n using (edition_id) left join k using (edition_id)")
def c12(spark, d):
    return rd.edition_summary(table(spark, d, "edition"), table(spark, d, "chapter"))


@reg.add("c14_wanted_formats", "select distinct slug, format from edition cross join (select unnest(['epub', 'pdf']) as format) where not (edition_id % 2 = 0 and format = 'pdf') except select slug, 'pdf' from edition where edition_id % 2 = 0")
def c14(spark, d):
    e = table(spark, d, "edition")
    carried = e.filter("edition_id % 2 = 0").select("slug", F.lit("pdf").alias("format"))
    return rd.wanted_formats(e.select("slug").distinct(), ["epub", "pdf"], carried)
