"""Queries of scalar text functions and text repair. Where the tables lack the damage that an
operator repairs, both sides inject the same damage first."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import repair as rp
from lectern.plans.registry import BOOK, LINES, PARAS, Registry, book, lines_of, paras, sql_hash, sql_strip
from lectern.session import table

reg = Registry()
queries, oracle_sql = lambda: dict(reg.queries), lambda: dict(reg.sql)
h = tx.content_hash


# --- scalars ----------------------------------------------------------------------------


@reg.add(
    "f_scalars",
    f"""select sent_id, {sql_hash('text')} as h, substring(sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')), 1, 16) as escaped,
      case when length(text) <= 60 then text else rtrim(substring(text, 1, 59)) || '…' end as short,
      regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}.-]+', '-', 'g'), '^-+|-+$', '', 'g') as safe,
      regexp_extract(text, '(\\S+)\\s*$', 1) as last_word
    from sentence""",
)
def f_scalars(spark, d):
    t = F.col("text")
    return table(spark, d, "sentence").select("sent_id", h(t).alias("h"), h(tx.html_escape(t)).alias("escaped"), tx.shorten(t, 60).alias("short"), tx.safe_name(t).alias("safe"), tx.surname(t).alias("last_word"))


@reg.add("f_slugs", "select edition_id, trim(regexp_replace(strip_accents(lower(page)), '[^a-z0-9]+', '-', 'g'), '-') as slug, slug as given from edition where page is not null")
def f_slugs(spark, d):
    return table(spark, d, "edition").filter("page is not null").select("edition_id", tx.slug(F.col("page")).alias("slug"), F.col("slug").alias("given"))


@reg.add("f_zero_width", f"select h, {sql_hash(sql_strip('''regexp_replace(text, '[\\p{Cf}]+', '', 'g')'''))} as clean, length(text) - length(regexp_replace(text, '[\\p{{Cf}}]', '', 'g')) as n from unit where text is not null".replace("{{Cf}}", "{Cf}"))
def f_zero_width(spark, d):
    u = table(spark, d, "unit").filter("text is not null")
    return u.select("h", h(tx.strip(tx.without_format(F.col("text")))).alias("clean"), F.regexp_count("text", F.lit(r"\p{Cf}")).cast("bigint").alias("n"))


@reg.add("f_accent_classes", "with k as (select edition_id, strip_accents(lower(author)) as k from book_info where author is not null) select edition_id, min(edition_id) over (partition by k) as class, count(*) over (partition by k) as members from k")
def f_accent_classes(spark, d):
    """Authors equal but for accents and case: each row with its class, no pairs."""
    e = table(spark, d, "book_info").filter("author is not null").select("edition_id", tx.mark_fold_udf("author").alias("k"))
    n = e.groupBy("k").agg(F.min("edition_id").alias("class"), F.count("*").alias("members"))
    return e.join(n, "k").select("edition_id", "class", "members")


@reg.add("f_cut_at_word", "select sent_id, case when length(text) // 2 >= length(text) then length(text) when instr(substring(text, length(text) // 2 + 1), ' ') > 0 then length(text) // 2 + instr(substring(text, length(text) // 2 + 1), ' ') - 1 else length(text) end as at from sentence")
def f_cut_at_word(spark, d):
    return table(spark, d, "sentence").select("sent_id", tx.cut_at_word(F.col("text"), F.lit(0.5)).cast("bigint").alias("at"))


@reg.add("f_vector", "select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f_vector(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return e.join(b, "vec_id").select("vec_id", F.round(tx.dot(F.col("embedding"), F.col("o")), 6).alias("dot"))


# --- R: repair ----------------------------------------------------------------------------

LIG = "text"
for glyph, letters in rp.LIGATURES.items():
    LIG = f"replace({LIG}, '{glyph}', '{letters}')"


@reg.add("r1_ligatures", f"select h, {sql_hash(LIG)} as fixed, length(text) - length(regexp_replace(text, '[ﬀ-ﬆ]', '', 'g')) as n from unit where text is not null")
def r1(spark, d):
    text, n = rp.expand_ligatures(F.col("text"))
    return table(spark, d, "unit").filter("text is not null").select("h", h(text).alias("fixed"), n.cast("bigint").alias("n"))


MARK = r"(?i)\[\s*(?:pg|page)\.?\s*[ivxlcdm\d]+\s*\]"


@reg.add("r2_page_marks", f"with {BOOK} select doc, {sql_hash(f'''regexp_replace(text, '{MARK}', ' ', 'g')''')} as fixed, len(regexp_extract_all(text, '{MARK}')) as n from book")
def r2(spark, d):
    text, n = rp.remove_page_marks(F.col("text"))
    return book(spark, d).select("doc", h(text).alias("fixed"), n.cast("bigint").alias("n"))


HEADED = "book as (select chapter_id as doc, regexp_replace(number_token, ' ', chr(10) || chr(10)) || chr(10) || array_to_string(paragraphs, chr(10)) as text from chapter where number_token is not null and len(paragraphs) > 0)"


@reg.add(
    "r3_split_headings",
    rf"""with {HEADED}, {LINES}, l as (select *, lead(line, 1) over w a1, lead(line, 2) over w a2, lead(line, 3) over w a3 from lines window w as (partition by doc order by line_no)),
    m as (select *, lower(regexp_replace({sql_strip('line')}, '\.+$', '')) in ('chapitre', 'chapter') as head, case when trim(a1) <> '' then a1 when trim(a2) <> '' then a2 when trim(a3) <> '' then a3 end as num from l),
    k as (select doc, line_no, line || ' ' || trim(num) as line from m where head and regexp_matches(trim(num), '^(?i)([ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\.?$'))
    select * from k""",
)
def r3(spark, d):
    c = table(spark, d, "chapter").filter("number_token is not null and size(paragraphs) > 0")
    texts = c.select(F.col("chapter_id").alias("doc"), F.concat(F.regexp_replace("number_token", " ", "\n\n"), F.lit("\n"), F.array_join("paragraphs", "\n")).alias("text"))
    return rp.rejoin_headings(lines_of(texts)).filter("joined").select("doc", F.col("line_no").cast("bigint").alias("line_no"), "line")


@reg.add("r4_dehyphenate")
def r4(spark, d):
    """Words whole again in every chapter; a fold over its lines, checked in the tests."""
    return book(spark, d).select("doc", rp.dehyphenate("text").alias("r")).select("doc", h(F.col("r.text")).alias("fixed"), F.col("r.healed").alias("healed"))


BLOCKS = "b as (select doc, list_filter(list_transform(string_split(regexp_replace(text, '\\n[\\s\\p{Z}]*\\n', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') as b, list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))), lambda n: n > 0)) as l from book)"


@reg.add(
    "r5_r7_layout",
    rf"""with {BOOK}, {BLOCKS}, s as (select *, list_filter(b, lambda x: not contains(x, chr(10))) as single from b),
    v as (select doc, coalesce(l[floor(len(l) * 0.9)::int + 1], 0) as measure, len(b) as n_blocks, list_sort(list_transform(b, lambda x: length(x)))[len(b) // 2 + 1] as block_median,
      list_sort(list_transform(single, lambda x: length(x)))[len(single) // 2 + 1] as typical, len(list_filter(single, lambda x: regexp_matches(x, '[.!?…:;—–]["”»’'')\]]?$'))) as closing, len(single) as k from s)
    select doc, measure, n_blocks, block_median, coalesce(block_median > 2000, false) as never_broke,
      coalesce(n_blocks >= 20 and k >= n_blocks * 0.9 and typical <= 200 and typical >= measure * 0.8 and closing < k * 0.4, false) as broke_every_line from v""",
)
def r5(spark, d):
    return rp.layout(book(spark, d)).select("doc", *[F.col(c).cast("bigint").alias(c) for c in ("measure", "n_blocks", "block_median")], "never_broke", "broke_every_line")


MEASURE = "m as (select doc, coalesce(l[floor(len(l) * 0.9)::int + 1], 0) as measure from (select doc, list_sort(list_filter(list_transform(list(line), lambda x: length(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))), lambda n: n > 0)) as l from lines group by doc))"


@reg.add(
    "r8_unfuse",
    rf"""with {BOOK}, {LINES}, {MEASURE}, s as (select doc, line_no, {sql_strip('line')} as here, {sql_strip("coalesce(lead(line) over (partition by doc order by line_no), '')")} as below from lines)
    select doc, line_no from s join m using (doc) where here <> '' and length(here) < measure * 0.8 and regexp_matches(here, '[.!?…]["”»’'']?$') and regexp_matches(below, '^["“«‘(]?[A-ZÀ-Þ]')""",
)
def r8(spark, d):
    return rp.unfuse(lines_of(book(spark, d))).filter("breaks").select("doc", F.col("line_no").cast("bigint").alias("line_no"))


INDENTED = "book as (select chapter_id as doc, array_to_string(list_transform(paragraphs, lambda p: '   ' || p), chr(10)) as text from chapter where paragraphs is not null)"
MARKS = """i as (select doc, line_no, line, length(line) - length(ltrim(line, ' ')) as col from lines where regexp_matches(line, '[^\\s\\p{Z}]')),
    n as (select doc, col, count(*) as n, min(line_no) as seen from i group by all),
    f as (select doc, arg_max(col, (n, -seen)) as flush, max(n) as fn, sum(n) as total from n group by doc),
    g as (select doc, arg_max(n.col, (n.n, -n.seen)) as ind, max(n.n) as dn from n join f using (doc) where n.col > f.flush group by doc),
    marks as (select doc, case when dn >= total * 0.1 and dn < fn then flush + (ind - flush + 1) // 2 else 0 end as mark from f left join g using (doc))"""


def indented(spark, d):
    return lines_of(book(spark, d, F.transform("paragraphs", lambda p: F.concat(F.lit("   "), p)), "\n"))


@reg.add("r9_indent_mark", f"with {INDENTED}, {LINES}, {MARKS} select doc, cast(mark as int) as mark from marks")
def r9(spark, d):
    return rp.indent_marks(indented(spark, d))


@reg.add(
    "r10_split_on_indent",
    rf"""with {INDENTED}, {LINES}, {MARKS}, {MEASURE},
    a as (select *, coalesce(lag(line) over (partition by doc order by line_no), '') as raw_above from lines),
    w as (select doc, line_no, line, {sql_strip('line')} as here, not regexp_matches(raw_above, '[^\s\p{{Z}}]') as above_blank, lag(line) over (partition by doc order by line_no) as last, coalesce(lead(line) over (partition by doc order by line_no), '') as nxt from a where regexp_matches(line, '[^\s\p{{Z}}]')),
    z as (select *, {sql_strip('last')} as above, length(line) - length(ltrim(line, ' ')) as ind, length(nxt) - length(ltrim(nxt, ' ')) as nind from w join marks using (doc) join m using (doc) where mark > 0)
    select doc, line_no from z where last is not null and ((ind >= mark and (regexp_matches(above, '[.!?…:;—–]["”»’'')\]]?$') or regexp_matches(here, '^(?:[—–]\s|["“«''(]?[A-ZÀ-Þ])')))
      or (ind < mark and measure > 0 and length(here) < measure * 0.5 and regexp_matches(here, '[.!?…:;—–]["”»’'')\]]?$') and nxt <> '' and nind >= mark and (above_blank or regexp_matches(above, '[.!?…:;—–]["”»’'')\]]?$'))))""",
)
def r10(spark, d):
    return rp.split_on_indent(indented(spark, d)).filter("starts").select("doc", F.col("line_no").cast("bigint").alias("line_no"))


@reg.add("r12_licence", "select doc_id as doc, case when doc_id % 2 = 0 then length(ltrim(text, chr(10))) + 2 else length(text) + length('*** END OF THE PROJECT GUTENBERG EBOOK X ***') + 9 end as n from documents where text is not null")
def r12(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    head, tail = "Head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n", "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nLicence"
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), "text", F.lit(tail))
    return t.select(F.col("doc_id").alias("doc"), F.length(rp.licence_body(text)).cast("bigint").alias("n"))


CHROME = "book as (select chapter_id as doc, 'Lire' || chr(10) || array_to_string(paragraphs, chr(10)) || chr(10) || '◄ I' || chr(10) || chr(8203) || chr(10) || 'Ce texte est dans le domaine public' || case when chapter_id % 3 = 0 then chr(10) || '↑ Note' || chr(10) || 'suite' else '' end as text from chapter where paragraphs is not null)"


def chrome(spark, d):
    t = book(spark, d, joined="\n")
    note = F.when(F.col("doc") % 3 == 0, "\n↑ Note\nsuite").otherwise("")
    return lines_of(t.select("doc", F.concat(F.lit("Lire\n"), "text", F.lit("\n◄ I\n​\nCe texte est dans le domaine public"), note).alias("text")))


@reg.add(
    "r12_r13_boilerplate",
    rf"""with {CHROME}, {LINES}, c as (select *, {sql_strip("regexp_replace(line, '[\\p{Cf}]+', '', 'g')".replace('{Cf}', '{{Cf}}')).replace('{{Cf}}', '{Cf}')} as clean, {sql_strip('line')} as bare, min(case when ltrim(line, ' ') like '↑%' then line_no end) over (partition by doc) as notes from lines),
    k as (select doc, line_no, bare as detail, case when line_no >= notes then 'note apparatus' when bare <> '' and clean = '' then 'invisible' when clean in ('Lire', 'Texte', 'Source', 'Discussion', 'Modifier', 'Outils', 'Télécharger') then 'menu'
      when clean <> '' and regexp_matches(clean, '^\s*[◄◀]\s*\S.*$|^.*\S\s*[►▶]\s*$|^\s*[▲^]\s*$|^\S.*/Texte entier$|^<\s+\S|^(?i:Catégorie(?:s)?\s*:)') then 'navigation' when clean <> '' and regexp_matches(clean, '(?i)domaine public|this work is in the public domain') then 'notice' end as kind from c)
    select doc, line_no, 'boilerplate' as stage, kind, detail from k where kind is not null and detail <> ''""",
)
def r13(spark, d):
    return rp.strip_boilerplate(chrome(spark, d))[1].withColumn("line_no", F.col("line_no").cast("bigint"))


@reg.add("a9_removal_report", reg.sql["r12_r13_boilerplate"].replace("select doc, line_no, 'boilerplate' as stage, kind, detail from k where", "select kind, count(*) as n, list_sort(list_distinct(list(detail)))[1:3]::varchar[] as examples from k where") + " group by kind")
def a9(spark, d):
    """Removals a kind, with three examples."""
    gone = rp.strip_boilerplate(chrome(spark, d))[1]
    return gone.groupBy("kind").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("detail")), 1, 3).alias("examples"))


NOTED = "book as (select chapter_id as doc, '(1752)' || chr(10) || chr(10) || array_to_string(list_transform(paragraphs, lambda p, i: p || case when i % 3 = 0 then '[' || i || ']' else '' end), chr(10) || chr(10)) || chr(10) || chr(10) || '* * *' || chr(10) || chr(10) || '12' || chr(10) || chr(10) || '[3] Note' as text from chapter where paragraphs is not null)"


@reg.add(
    "r14_r15_blocks",
    rf"""with {NOTED}, b0 as (select doc, unnest(a) as b, unnest(range(len(a))) as block from (select doc, string_split(regexp_replace({sql_strip('text')}, '\n[\s\p{{Z}}]*\n+', chr(1), 'g'), chr(1)) as a from book)),
    b1 as (select doc, block, list_filter(list_transform(string_split(b, chr(10)), lambda x: {sql_strip("regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g')".replace('{Z}', '{{Z}}')).replace('{{Z}}', '{Z}')}), lambda x: x <> '' and not regexp_matches(x, '^\[?\d{{1,4}}\]?$')) as lines from b0),
    b2 as (select *, case when not regexp_matches(array_to_string(lines, ''), '[\p{{L}}\p{{N}}]') then 'not prose' when len(list_filter(lines, lambda x: regexp_matches(x, '\(\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*\)'))) > 0 then 'citation?' when len(lines) = 1 and regexp_matches(lines[1], '^\(\s*\d{{3,4}}\s*\)$') then 'year?' when regexp_matches(lines[1], '^\[\d{{1,3}}\]\s') then 'note text' end as kind from b1 where len(lines) > 0),
    b3 as (select *, min(case when kind is null then block end) over (partition by doc) as plain from b2)
    select doc, block, case when kind in ('citation?', 'year?') and block < coalesce(plain, 1e9) then replace(kind, '?', '') when kind in ('citation?', 'year?') then null else kind end as kind,
      {sql_hash("array_to_string(case when kind is null or (kind in ('citation?', 'year?') and block > coalesce(plain, 1e9)) then list_transform(lines, lambda x: regexp_replace(x, '(.)(?:\\[\\d{1,3}\\])+', '\\1', 'g')) else lines end, ' ')".replace('{1,3}', '{{1,3}}')).replace('{{1,3}}', '{1,3}')} as h from b3""",
)
def r14(spark, d):
    marked = F.transform("paragraphs", lambda p, i: F.when((i + 1) % 3 == 0, F.concat(p, F.lit("["), (i + 1).cast("string"), F.lit("]"))).otherwise(p))
    t = book(spark, d, marked)
    t = t.select("doc", F.concat(F.lit("(1752)\n\n"), "text", F.lit("\n\n* * *\n\n12\n\n[3] Note")).alias("text"))
    return rp.build_blocks(t).select("doc", F.col("block").cast("bigint").alias("block"), "kind", h(F.array_join("lines", " ")).alias("h"))


WITH_NOTES = "paras as (select chapter_id as doc, unnest(range(len(a))) as pos, unnest(a) as text from (select chapter_id, list_concat(list_transform(list_filter(paragraphs, lambda p: p is not null), lambda p, i: p || case when i = 1 then '[7]' else '' end), ['[7] Une note', '1. Fin', '2. Suite']) as a from chapter where paragraphs is not null))"


def with_notes(spark, d):
    marked = F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), lambda p, i: F.when(i == 0, F.concat(p, F.lit("[7]"))).otherwise(p))
    notes = F.array(*[F.lit(x) for x in ("[7] Une note", "1. Fin", "2. Suite")])
    c = table(spark, d, "chapter").filter("paragraphs is not null")
    return c.select(F.col("chapter_id").alias("doc"), F.posexplode(F.concat(marked, notes)).alias("pos", "text"))


@reg.add(
    "r16_r17_notes",
    rf"""with {WITH_NOTES}, n as (select doc, pos, text, nullif(translate(regexp_extract(regexp_extract(text, '^(?:\[(\d{{1,3}})\]\s+|\((\d{{1,3}})\)\s+|([¹²³⁴⁵⁶⁷⁸⁹])\s*|(\d{{1,3}})\.\s+)', 0), '(\d{{1,3}}|[¹²³⁴⁵⁶⁷⁸⁹])', 1), '¹²³⁴⁵⁶⁷⁸⁹', '123456789'), '')::int as n from paras),
    refs as (select distinct doc, unnest(list_concat(regexp_extract_all(text, '\S\[(\d{{1,3}})\]', 1), regexp_extract_all(text, '[\p{{L}}\p{{N}}_]\((\d{{1,3}})\)', 1), list_transform(regexp_extract_all(text, '\S([¹²³⁴⁵⁶⁷⁸⁹])', 1), lambda x: translate(x, '¹²³⁴⁵⁶⁷⁸⁹', '123456789'))))::int as n from paras),
    o as (select *, lead(n) over w as nxt, lead(pos) over w as npos from n window w as (partition by doc order by pos)),
    q as (select *, sum(case when n is null or (npos is not null and nxt is distinct from n + 1) then 1 else 0 end) over (partition by doc order by pos desc) as broken from o),
    t as (select *, count(case when broken = 0 then 1 end) over (partition by doc) as run from q)
    select t.doc, t.pos, t.n as note from t left join refs on refs.doc = t.doc and refs.n = t.n where t.n is not null and (refs.n is not null or (broken = 0 and run >= 2))""",
)
def r16(spark, d):
    return rp.remove_notes(with_notes(spark, d)).filter("note is not null").select("doc", F.col("pos").cast("bigint").alias("pos"), "note")


@reg.add("r18_fused_notes")
def r18(spark, d):
    """Paragraphs that carry a whole apparatus, over every paragraph (one is put at every chapter's end)."""
    c = table(spark, d, "chapter").filter("size(paragraphs) > 0")
    c = c.select(F.col("chapter_id").alias("doc"), F.size("paragraphs").alias("n"), F.posexplode("paragraphs").alias("pos", "text")).filter("text is not null")
    fused = F.when(F.col("pos") == F.col("n") - 1, F.concat("text", F.lit(" [1] - Un mot. [2] - Deux mots. [3] Trois."))).otherwise(F.col("text"))
    return c.select("doc", "pos", rp.fused_notes(fused).alias("r")).select("doc", "pos", h(F.col("r.prose")).alias("prose"), F.col("r.notes").alias("notes"))


RUN_TOGETHER = rf"""with {PARAS}, j as (select edition_id, pos, doc, regexp_replace(text, '(\p{{L}}{{4,}}) (\p{{L}}{{4,}})', '\1\2') as text from paras),
    w as (select edition_id, doc, pos, unnest(regexp_extract_all(lower(text), '[\p{{L}}]{{2,}}')) as word from j),
    n as (select edition_id, word, count(*) as n from w group by all), t as (select * from n where n >= 3),
    c as (select edition_id, word, unnest(range(2, length(word) - 1)) as i from n where n < 3 and length(word) >= 6),
    cases as (select c.edition_id, c.word, substring(c.word, 1, i) as "left", substring(c.word, i + 1) as "right" from c join t a on a.edition_id = c.edition_id and a.word = substring(c.word, 1, i) join t b on b.edition_id = c.edition_id and b.word = substring(c.word, i + 1))"""


def joined_words(spark, d):
    """Paragraphs with their first two long words run together."""
    return paras(spark, d).withColumn("text", F.regexp_replace("text", r"^((?s:.)*?)(\p{L}{4,}) (\p{L}{4,})", "$1$2$3"))


@reg.add("r19_run_together", RUN_TOGETHER + ' select edition_id, word, "left", "right" from cases')
def r19(spark, d):
    return rp.run_together(joined_words(spark, d), "edition_id")


@reg.add("r20_suspects", RUN_TOGETHER + " select distinct w.doc, w.pos from w join cases using (edition_id, word)")
def r20(spark, d):
    p = joined_words(spark, d)
    p = p.select("edition_id", F.struct("doc", "pos").alias("pos"), "text")
    return rp.suspects(p, rp.run_together(p, "edition_id"), "edition_id").select("pos.doc", F.col("pos.pos").cast("bigint").alias("pos"))


@reg.add(
    "r21_respaced",
    """with r as (select sent_id, text, case when sent_id % 3 = 0 then replace(text, ',', ' ,') when sent_id % 3 = 1 then replace(text, 'e', 'é') else text end as reply from sentence)
    select sent_id, case when sent_id % 3 = 0 and contains(text, ',') then trim(regexp_replace(reply, '[\\s\\p{Z}]+', ' ', 'g')) end as made from r where sent_id % 3 <> 1 or not contains(text, 'e')
    union all select sent_id, null from r where sent_id % 3 = 1 and contains(text, 'e')""",
)
def r21(spark, d):
    s = table(spark, d, "sentence")
    reply = F.when(F.col("sent_id") % 3 == 0, F.replace("text", F.lit(","), F.lit(" ,"))).when(F.col("sent_id") % 3 == 1, F.replace("text", F.lit("e"), F.lit("é"))).otherwise(F.col("text"))
    return s.select("sent_id", rp.respaced(F.col("text"), reply).alias("made"))


@reg.add("r22_changed_words", "select sent_id, list_filter(string_split(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), ' '), lambda w: not list_contains(string_split(trim(regexp_replace(replace(text, 'e', 'é'), '[\\s\\p{Z}]+', ' ', 'g')), ' '), w)) as words from sentence")
def r22(spark, d):
    return table(spark, d, "sentence").select("sent_id", rp.changed_words(F.col("text"), F.replace("text", F.lit("e"), F.lit("é"))).alias("words"))


@reg.add("r23_usable", f"with {PARAS} select edition_id as doc, count(*) as n, list_sort(list(length(text)))[count(*) // 2 + 1] as typical, list_sort(list(length(text)))[count(*) // 2 + 1] <= 6000 as usable from paras group by 1")
def r23(spark, d):
    p = paras(spark, d).select(F.col("edition_id").alias("doc"), "text")
    return rp.usable(p).withColumn("typical", F.col("typical").cast("bigint"))
