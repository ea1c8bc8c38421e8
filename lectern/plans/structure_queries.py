"""Queries of structure detection, packing, trimming and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.numbers import chapter_number, roman_text, roman_value
from lectern.functions.text import content_hash as h
from lectern.operators import packing as pk
from lectern.operators import structure as st
from lectern.operators import trim as tr
from lectern.plans.registry import PARAS, Registry, lines_of, paras, sql_hash, sql_strip
from lectern.session import table

reg = Registry()
queries, oracle_sql = lambda: dict(reg.queries), lambda: dict(reg.sql)

ROMANS = "['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii']"
WORDS = "['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve']"


def sql_num(token: str) -> str:
    """Numbers of the tokens that occur, an own reading: digits, words to twelve, numerals to XII."""
    w = rf"lower(regexp_replace({token}, '^(?i)(?:chapitre|chapter)\s+|\.$', '', 'g'))"
    return rf"cast(coalesce(try_cast(nullif(regexp_extract({token}, '(\d+)', 1), '') as int), nullif(list_position({WORDS}, {w}), 0), nullif(list_position({ROMANS}, {w}), 0)) as bigint)"


SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?…](?:[    ]?[\"»”’'')\]])*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')".replace('\\"', '"')


def sql_sentences(text: str) -> str:
    return SENT.format(text)


@reg.add("g1_chapter_number", f"select chapter_id, {sql_num('number_token')} as num from chapter where number_token is not null")
def g1(spark, d):
    return table(spark, d, "chapter").filter("number_token is not null").select("chapter_id", chapter_number(F.col("number_token")).cast("bigint").alias("num"))


#: Compound ordinals of the two languages, one for each chapter, and what they are worth.
SPELLED = {
    "fr": (["vingt", "trente", "quarante", "cinquante"], ["unième", "deuxième", "troisieme", "quatrième", "cinquieme", "sixième", "septième", "huitième", "neuvième"]),
    "en": (["twenty", "thirty", "forty", "fifty"], ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth"]),
}


@reg.add(
    "g1_spelled_numbers",
    "with n as (select chapter_id, chapter_id % 4 as t, (chapter_id // 4) % 9 as u from chapter where chapter_id is not null), k as (select *, unnest(['fr', 'en', 'hundreds']) as kind from n) "
    "select chapter_id, kind, case when kind = 'hundreds' then 100 * (t + 2) + 20 + 10 * t + 1 + u else 20 + 10 * t + 1 + u end as num from k",
)
def g1_spelled(spark, d):
    """Compound ordinals and cardinals over a hundred, read back; the SQL knows the numbers they were made of."""
    c = table(spark, d, "chapter").filter("chapter_id is not null").select("chapter_id", (F.col("chapter_id") % 4 + 1).cast("int").alias("t"), ((F.col("chapter_id") / 4).cast("bigint") % 9 + 1).cast("int").alias("u"))
    part = lambda words, k: F.element_at(F.array(*map(F.lit, words)), k)
    token = {k: F.concat(F.lit("Chapter " if k == "en" else "chapitre "), part(tens, F.col("t")), F.lit("-"), part(units, F.col("u"))) for k, (tens, units) in SPELLED.items()}
    ones = part(["un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"], F.col("u"))
    token["hundreds"] = F.concat_ws(" ", part(["deux", "trois", "quatre", "cinq"], F.col("t")), F.lit("cents"), part(SPELLED["fr"][0], F.col("t")), F.lit("et"), ones)
    rows = c.select("chapter_id", F.explode(F.create_map(*[x for k, v in token.items() for x in (F.lit(k), v)])).alias("kind", "token"))
    return rows.select("chapter_id", "kind", chapter_number(F.col("token")).cast("bigint").alias("num"))


@reg.add("g2_roman", "select distinct c_custkey as n, c_custkey as back, length(regexp_replace(c_custkey::varchar, '', '')) > 0 as written from customer where c_custkey between 1 and 3999")
def g2(spark, d):
    """Roman numerals written and read back."""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("n")).filter("n between 1 and 3999").distinct()
    text = roman_text(F.col("n"))
    return n.select("n", roman_value(text).cast("bigint").alias("back"), (F.length(text) > 0).alias("written"))


@reg.add("g4_number_tokens")
def g4(spark, d):
    """Figures and runs of number words of every sentence as tokens."""
    return table(spark, d, "sentence").select("sent_id", st.number_tokens_udf("text").alias("tokens"))


HEADS = r"""lines as (select doc, unnest(range(len(a))) as line_no, unnest(a) as line from (select doc_id as doc, string_split(text, chr(10)) as a from documents where text is not null)),
    heads as (select doc, line_no, regexp_extract(line, '^\s*(?i:CHAPITRE|CHAPTER)\s+([IVXLCDMivxlcdm]+|\d+|[A-Za-zÀ-ÿ]+(?:-[A-Za-zÀ-ÿ]+)*)\s*\.?\s*$', 1) as token from lines)"""


def doc_lines(spark, d):
    return lines_of(table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), "text"))


@reg.add("g5_headings", f"with {HEADS} select doc, line_no, token from heads where token <> ''")
def g5(spark, d):
    return st.explicit_headings(doc_lines(spark, d)).select("doc", F.col("line_no").cast("bigint").alias("line_no"), "token")


#: One text an edition: each chapter's number on a line, then its elements.
EDITION = f"""parts as (select edition_id as doc, ch_idx, -1 as k, number_token as line from chapter where number_token is not null union all
      select edition_id, ch_idx, k, line from (select edition_id, ch_idx, unnest(range(len(paragraphs))) as k, replace(unnest(paragraphs), chr(10), ' ') as line from chapter) where line is not null),
    lines as (select doc, row_number() over (partition by doc order by ch_idx, k) - 1 as line_no, line, k = -1 as head, {sql_num('line')} as num from parts)"""


def edition_lines(spark, d):
    c = table(spark, d, "chapter")
    heads = c.filter("number_token is not null").select(F.col("edition_id").alias("doc"), "ch_idx", F.lit(-1).alias("k"), F.col("number_token").alias("line"))
    body = c.select(F.col("edition_id").alias("doc"), "ch_idx", F.posexplode("paragraphs").alias("k", "line")).filter("line is not null").withColumn("line", F.replace("line", F.lit("\n"), F.lit(" ")))
    w = Window.partitionBy("doc").orderBy("ch_idx", "k")
    return heads.unionByName(body).withColumn("line_no", F.row_number().over(w) - 1)


def edition_heads(spark, d):
    """The numbered lines as headings."""
    return edition_lines(spark, d).filter("k = -1").select("doc", "line_no", F.col("line").alias("token"), chapter_number(F.col("line")).alias("num"))


@reg.add(
    "g6_spine",
    rf"""with {EDITION}, n as (select *, sum(head::int) over (partition by doc order by line_no) as n from lines),
    under as (select doc, n from n where not head and n > 0 group by all having sum(length({sql_strip('line')})) >= 10 and bool_or(regexp_matches(line, '\p{{Ll}}'))),
    kept as (select * from n semi join under using (doc, n) where head),
    f as (select *, min(case when coalesce(num, 0) <= 2 then line_no end) over (partition by doc) as first from kept)
    select doc, line_no, num from f where line_no >= first""",
)
def g6(spark, d):
    lines = edition_lines(spark, d).select("doc", "line_no", "line")
    return st.spine(edition_heads(spark, d), lines).select("doc", F.col("line_no").cast("bigint").alias("line_no"), F.col("num").cast("bigint").alias("num"))


@reg.add("g7_numeral_headings")
def g7(spark, d):
    """Chapters of editions that mark them by a numeral alone."""
    return st.numeral_headings(edition_lines(spark, d).select("doc", "line_no", "line"))


@reg.add("g8_dated_headings")
def g8(spark, d):
    """Diary headings: each edition's chapters headed by the days of a week, blank lines set around."""
    e = edition_lines(spark, d)
    days = F.array(*[F.lit(x.capitalize() + ".") for x in st.WEEKDAYS])
    lines = e.select("doc", "line_no", F.when(F.col("k") == -1, F.element_at(days, (F.col("ch_idx") % 14 + 1).cast("int"))).otherwise(F.col("line")).alias("line"), (F.col("k") == -1).alias("head"))
    spread = lines.select("doc", F.explode(F.when(F.col("head"), F.array(F.struct((F.col("line_no") * 3).alias("line_no"), F.lit("").alias("line")), F.struct((F.col("line_no") * 3 + 1).alias("line_no"), "line"), F.struct((F.col("line_no") * 3 + 2).alias("line_no"), F.lit("").alias("line")))).otherwise(F.array(F.struct((F.col("line_no") * 3).alias("line_no"), "line")))).alias("x"))
    return st.dated_headings(spread.select("doc", "x.line_no", "x.line"))


@reg.add("g9_opened", rf"with {EDITION} select a.doc, a.line_no, coalesce(regexp_matches({sql_strip('(select arg_min(b.line, b.line_no) from lines b where b.doc = a.doc and b.line_no > a.line_no and trim(b.line) <> chr(32))')}, '^(?:[—–]\s|[\"“«''(]?[A-ZÀ-Þ])'), false) as opens from lines a where a.head".replace('\\"', '"').replace("<> chr(32)", "<> ''"))
def g9(spark, d):
    return st.opened(edition_heads(spark, d), edition_lines(spark, d).select("doc", "line_no", "line")).select("doc", F.col("line_no").cast("bigint").alias("line_no"), "opens")


@reg.add("g10_titles", f"""with p as (select chapter_id as doc, list_filter(paragraphs, lambda x: x is not null) as a, title from chapter), b as (select doc, list_concat(case when title is null then [] else [title] end, a) as a from p)
    select doc, case when len(a) > 1 and a[1] <> '' and length(replace(a[1], chr(10), ' ')) <= 160 and (not contains(a[1], chr(10)) or length(a[1]) * 2 <= length(a[2])) then replace(a[1], chr(10), ' ') end as title from b where len(a) > 0""")
def g10(spark, d):
    a = F.filter(F.concat(F.array("title"), F.coalesce("paragraphs", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    b = table(spark, d, "chapter").select(F.col("chapter_id").alias("doc"), F.posexplode(a).alias("block", "t"))
    return st.split_title(b.select("doc", "block", F.split("t", "\n").alias("lines")))


@reg.add(
    "g11_parts",
    rf"""with {EDITION}, b as (select *, case when num <= lag(num) over (partition by doc order by line_no) then 1 else 0 end as back from lines where head),
    p as (select *, 1 + sum(back) over (partition by doc order by line_no) as part from b) select doc, line_no, case when max(part) over (partition by doc) > 1 then part end::int as part from p""",
)
def g11(spark, d):
    return st.parts(edition_heads(spark, d)).select("doc", F.col("line_no").cast("bigint").alias("line_no"), "part")


@reg.add("g12_chapters")
def g12(spark, d):
    """Each edition's chapters by the first of its kinds of heading that gives a spine."""
    return st.chapters(edition_lines(spark, d).select("doc", "line_no", "line"))


@reg.add("g13_sentences", f"with {PARAS}, s as (select doc, pos, {sql_sentences('text')} as s from paras) select doc, pos, len(s) as n, {sql_hash('array_to_string(s, chr(10))')} as h from s")
def g13(spark, d):
    p = paras(spark, d).select("doc", F.col("pos").cast("bigint").alias("pos"), st.sentences(F.col("text")).alias("s"))
    return p.select("doc", "pos", F.size("s").cast("bigint").alias("n"), h(F.array_join("s", "\n")).alias("h"))


@reg.add("g14_speech_pieces")
def g14(spark, d):
    """Sentences parted at introduced speech (needs look-behind, which the SQL lacks; tested on cases)."""
    p = paras(spark, d).select("doc", "pos", st.speech_pieces(F.col("text")).alias("s"))
    return p.select("doc", "pos", F.size("s").alias("n"), h(F.array_join("s", "\n")).alias("h"))


@reg.add("g23_dash_speech", rf"""with {PARAS}, s as (select doc, pos, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;…»"])\s+[—–]\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') as s from paras) select doc, pos, len(s) as n, {sql_hash('array_to_string(s, chr(10))')} as h from s""")
def g23(spark, d):
    p = paras(spark, d).select("doc", F.col("pos").cast("bigint").alias("pos"), st.dash_speech(F.col("text")).alias("s"))
    return p.select("doc", "pos", F.size("s").cast("bigint").alias("n"), h(F.array_join("s", "\n")).alias("h"))


@reg.add("g15_flat", "select doc_id % 20 as doc, list_sort(list(length(text)))[count(*) // 2 + 1] as typical, list_sort(list(length(text)))[count(*) // 2 + 1] > 1200 as flat from documents where text is not null group by 1")
def g15(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select((F.col("doc_id") % 20).alias("doc"), "text")
    return st.flat(t, "doc", 1200).withColumn("typical", F.col("typical").cast("bigint"))


PAIRS = "pairs as (select distinct fr_edition_id as book, en_edition_id as en from alignment_report)"
SHAPE = f"""{PAIRS}, sides as (select p.book, s.lang, c.ch_idx, s.p_idx, s.s_idx, s.text, s.sent_id from pairs p join chapter c on c.edition_id in (p.book, p.en) join sentence s using (chapter_id) where (c.edition_id = p.book) = (s.lang = 'fr')),
    pieces as (select book, row_number() over (partition by book order by ch_idx, p_idx, s_idx, sent_id) - 1 as k, length(text) as size from sides where lang = 'en'),
    shape as (select book, row_number() over (partition by book order by ch_idx, p_idx) - 1 as k, sum(length(text) + 1) - 1 as size from sides where lang = 'fr' group by book, ch_idx, p_idx)"""


def two_rulers(spark, d):
    pairs = table(spark, d, "alignment_report").select(F.col("fr_edition_id").alias("book"), F.col("en_edition_id").alias("en")).distinct()
    c, s = table(spark, d, "chapter").select("chapter_id", "edition_id", "ch_idx"), table(spark, d, "sentence")
    both = pairs.select("book", F.explode(F.array(F.struct(F.col("book").alias("edition_id"), F.lit("fr").alias("lang")), F.struct(F.col("en").alias("edition_id"), F.lit("en").alias("lang")))).alias("x")).select("book", "x.*")
    rows = both.join(c, "edition_id").join(s, ["chapter_id", "lang"])
    pieces = rows.filter("lang = 'en'").withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy("ch_idx", "p_idx", "s_idx", "sent_id")) - 1)
    shape = rows.filter("lang = 'fr'").groupBy("book", "ch_idx", "p_idx").agg((F.sum(F.length("text") + 1) - 1).alias("size"))
    shape = shape.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy("ch_idx", "p_idx")) - 1)
    return pieces.select("book", "k", F.length("text").alias("size")), shape.select("book", "k", "size")


@reg.add(
    "g16_cut_to_shape",
    f"""with {SHAPE}, e as (select book, k, sum(greatest(size, 1) + 1) over (partition by book order by k) as e from pieces), w as (select book, k, sum(greatest(size, 1) + 1) over (partition by book order by k) as e from shape),
    l as (select book, max(e) as length, count(*) as n from e group by 1), t as (select book, max(e) as total, count(*) as slots from w group by 1),
    x as (select w.book, w.k, w.e::double / total * length as x, n, slots from w join l using (book) join t using (book)),
    a as (select x.book, x.k, x.x, n, slots, count(case when e.e <= x.x then 1 end) as done, coalesce(max(case when e.e <= x.x then e.e end), 0) as before, min(case when e.e > x.x then e.e end) as after, bool_or(e.e = x.x) as exact from x join e using (book) group by all),
    s as (select *, max(case when k = slots - 1 or after is null then n when exact or x - before <= after - x then done else done + 1 end) over (partition by book order by k) as stop from a),
    z as (select *, coalesce(lag(stop) over (partition by book order by k), 0) as start from s)
    select book, k as slot, start as first, stop - 1 as last from z where stop > start""",
)
def g16(spark, d):
    return st.cut_to_shape(*two_rulers(spark, d)).withColumn("slot", F.col("slot").cast("bigint"))


@reg.add("g16_recovery")
def g16_recovery(spark, d):
    """Paragraphs that come back whole when an edition's sentences are cut against its own paragraphs."""
    c, s = table(spark, d, "chapter").select("chapter_id", "edition_id", "ch_idx"), table(spark, d, "sentence").filter("lang = 'fr'")
    rows = s.join(c, "chapter_id").withColumn("k", F.row_number().over(Window.partitionBy("edition_id").orderBy("ch_idx", "p_idx", "s_idx")) - 1)
    pieces = rows.select(F.col("edition_id").alias("book"), "k", F.length("text").alias("size"))
    shape = rows.groupBy(F.col("edition_id").alias("book"), "ch_idx", "p_idx").agg((F.sum(F.length("text") + 1) - 1).alias("size"), F.min("k").alias("first"), F.max("k").alias("last"))
    shape = shape.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy("ch_idx", "p_idx")) - 1)
    cut = st.cut_to_shape(pieces, shape.select("book", "k", "size")).withColumnsRenamed({"slot": "k", "first": "f", "last": "l"})
    got = shape.join(cut, ["book", "k"], "left")
    return got.groupBy("book").agg(F.count("*").alias("paragraphs"), F.count_if((F.col("f") == F.col("first")) & (F.col("l") == F.col("last"))).alias("whole"))


@reg.add("g17_recut", "select edition_id, case when chars > 20000 and not paragraphs > 100 then 'left' when paragraphs > 100 and not chars > 20000 then 'right' end as side from edition where chars is not null and paragraphs is not null")
def g17(spark, d):
    e = table(spark, d, "edition").filter("chars is not null and paragraphs is not null")
    return e.select("edition_id", st.recut_side(F.col("chars") > 20000, F.col("paragraphs") > 100).alias("side"))


@reg.add("g18_reply_numbers")
def g18(spark, d):
    """Rising numbers of model-like replies made of the books' own figures."""
    return table(spark, d, "sentence").select("sent_id", st.rising_numbers(F.col("text"), F.lit(1900)).alias("numbers"))


def sql_pack(most: int, count: int) -> str:
    return f"""with recursive {PARAS}, a as (select edition_id, row_number() over (partition by edition_id order by ch_idx, pos) as k, doc, pos, length(text) as size from paras),
    w(edition_id, k, g, s, n) as (select edition_id, k, 0, size, 1 from a where k = 1 union all
      select a.edition_id, a.k, case when w.s + a.size > {most} or w.n >= {count} then w.g + 1 else w.g end, case when w.s + a.size > {most} or w.n >= {count} then a.size else w.s + a.size end, case when w.s + a.size > {most} or w.n >= {count} then 1 else w.n + 1 end
      from w join a on a.edition_id = w.edition_id and a.k = w.k + 1)
    select edition_id, doc, pos, g as "group" from w join a using (edition_id, k)"""


def packed(spark, d, most, count):
    p = paras(spark, d)
    out = pk.pack_rows(p, "edition_id", ["ch_idx", "pos", "doc"], F.length("text"), most, count)
    return out.select("edition_id", "doc", F.col("pos").cast("bigint").alias("pos"), "group")


@reg.add("g19_pages", sql_pack(1400, 2_000_000_000))
def g19(spark, d):
    return packed(spark, d, 1400, 2_000_000_000)


@reg.add("g21_batches", sql_pack(6000, 4))
def g21(spark, d):
    return packed(spark, d, 6000, 4)


@reg.add("g21_gloss_batches", sql_pack(2500, 4))
def g21_gloss(spark, d):
    return packed(spark, d, 2500, 4)


@reg.add("g20_rescue_chunks")
def g20(spark, d):
    """Sentences of the documents' long paragraphs in slices of at most 700 characters, with their offsets."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n\n")).alias("pos", "text"))
    p = t.filter(F.length("text") > 700).select("doc", "pos", st.sentences(F.col("text")).alias("s"))
    g = p.withColumn("g", pk.greedy_groups(F.transform("s", F.length), 700, gap=1))
    z = g.select("doc", "pos", F.explode(F.arrays_zip("s", "g")).alias("z"))
    return z.groupBy("doc", "pos", F.col("z.g").alias("chunk")).agg(F.sum(F.length("z.s") + 1).alias("chars"), F.count("*").alias("sentences"))


@reg.add(
    "g22_opening",
    f"""with {PARAS}, b as (select edition_id, coalesce(sum(length(text)) over (partition by edition_id order by ch_idx, pos rows between unbounded preceding and 1 preceding), 0) as before from paras)
    select edition_id, count(*) as total, least(count(*), greatest(40, least(400, count(case when before < 40000 then 1 end)))) as opening from b group by 1""",
)
def g22(spark, d):
    return pk.opening(paras(spark, d), "edition_id", ["ch_idx", "pos"], F.length("text"))


# --- T: trimming ------------------------------------------------------------------------

#: Books with front and back matter put in: a title page and a licence line before, a bibliography behind.
MATTER = f"""books as (select edition_id as book, ch_idx, {sql_num('number_token')} as num, pos as p_idx, text from (select edition_id, ch_idx, number_token, unnest(range(len(paragraphs))) as pos, unnest(paragraphs) as text from chapter) where text is not null
    union all select edition_id, -1, null, 0, 'UN LIVRE' from edition union all select edition_id, -1, null, 1, 'Produced by hand' from edition
    union all select edition_id, 10000 , null, 0, 'fin' from edition where edition_id % 2 = 0 union all select edition_id, max(ch_idx), arg_max({sql_num('number_token')}, ch_idx), 9000, 'BIBLIOGRAPHIE.' from chapter group by 1 union all select edition_id, max(ch_idx), arg_max({sql_num('number_token')}, ch_idx), 9001, 'Un titre' from chapter group by 1)"""


def matter(spark, d):
    c = table(spark, d, "chapter").withColumn("num", chapter_number(F.col("number_token")))
    body = c.select(F.col("edition_id").alias("book"), "ch_idx", "num", F.posexplode("paragraphs").alias("p_idx", "text")).filter("text is not null")
    e = table(spark, d, "edition").select(F.col("edition_id").alias("book"))
    none = F.lit(None).cast("int")
    row = lambda df, ch, num, p, t: df.select("book", ch.cast("int").alias("ch_idx"), num.alias("num"), F.lit(p).alias("p_idx"), F.lit(t).alias("text"))
    last = c.groupBy(F.col("edition_id").alias("book")).agg(F.max(F.struct("ch_idx", "num")).alias("x")).select("book", "x.*")
    return (
        body.unionByName(row(e, F.lit(-1), none, 0, "UN LIVRE")).unionByName(row(e, F.lit(-1), none, 1, "Produced by hand")).unionByName(row(e.filter("book % 2 = 0"), F.lit(10000), none, 0, "fin"))
        .unionByName(row(last, F.col("ch_idx"), F.col("num"), 9000, "BIBLIOGRAPHIE.")).unionByName(row(last, F.col("ch_idx"), F.col("num"), 9001, "Un titre"))
    )


@reg.add(
    "t1_t3_trim_matter",
    rf"""with {MATTER}, a as (select *, min(case when num is not null then ch_idx end) over (partition by book) as lo, max(case when num is not null then ch_idx end) over (partition by book) as hi from books),
    b as (select *, sum(case when ch_idx < lo then length(text) else 0 end) over (partition by book) <= 0.25 * sum(length(text)) over (partition by book) and lo is not null as numbered,
      min(case when not (({sql_strip('text')}) <> '' and not regexp_matches({sql_strip('text')}, '^(?i)(?:introduction|pr[ée]face|prologue|foreword|avant-propos|avertissement)\b') and (regexp_matches({sql_strip('text')}, '(?i)^produced by') or (length({sql_strip('text')}) <= 60 and regexp_matches(text, '\p{{L}}') and not regexp_matches(text, '\p{{Ll}}') and not regexp_matches({sql_strip('text')}, '[.!?]$')))) then (ch_idx, p_idx) end) over (partition by book) as real from a),
    c as (select *, dense_rank() over (partition by book order by ch_idx) - 1 as rank from b where case when numbered then ch_idx between lo and hi else real is null or (ch_idx, p_idx) >= real end),
    d as (select *, max(rank + 1) over (partition by book) as n, min((ch_idx, p_idx)) over (partition by book) as first from c),
    e as (select *, min(case when numbered and rank >= n // 2 and lower(regexp_replace({sql_strip('text')}, '\.+$', '')) in ('bibliographie', 'notes', 'index') then (ch_idx, p_idx) end) over (partition by book) as back from d)
    select book, ch_idx, num, p_idx, {sql_hash('text')} as h from e where back is null or (ch_idx, p_idx) < back or back = first""",
)
def t1(spark, d):
    out = tr.trim_matter(matter(spark, d))
    return out.select("book", F.col("ch_idx").cast("int").alias("ch_idx"), F.col("num").cast("bigint").alias("num"), F.col("p_idx").cast("bigint").alias("p_idx"), h(F.col("text")).alias("h"))


@reg.add("t4_trim_edges", "with p as (select edition_id as book, chapter_id as pos, title is null as a from chapter), b as (select *, min(case when not a then pos end) over (partition by book) as lo, max(case when not a then pos end) over (partition by book) as hi from p) select book, pos from b where pos between lo and hi")
def t4(spark, d):
    c = table(spark, d, "chapter").select(F.col("edition_id").alias("book"), F.col("chapter_id").alias("pos"), "title")
    return tr.trim_edges(c, F.col("title").isNull()).select("book", "pos")


@reg.add("t5_without_notes", f"with {PARAS}, p as (select doc, pos, case when pos % 4 = 0 then '[2] ' || text else text end as text from paras) select doc, pos from p where not regexp_matches(text, '^\\[\\d+\\]')")
def t5(spark, d):
    p = paras(spark, d).withColumn("text", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("[2] "), "text")).otherwise(F.col("text")))
    return p.filter(tr.without_notes(F.col("text"))).select("doc", F.col("pos").cast("bigint").alias("pos"))


@reg.add("t6_pending", f"with l as (select doc_id, unnest(range(len(a))) as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents)), k as (select distinct {sql_hash('line')} as h, line_no, doc_id from l where trim(line) <> ''), f as (select h, min((doc_id, line_no)) as pos from k group by 1) select h, pos[1] as doc_id, pos[2] as line_no from f where h not in (select h from unit)")
def t6(spark, d):
    """Lines of the documents whose hash no unit holds: the first of each, once."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    u = lines.select(h(F.col("line")).alias("h"), F.struct("doc_id", "line_no").alias("pos"))
    return tr.pending(u, table(spark, d, "unit")).select("h", "pos.doc_id", F.col("pos.line_no").cast("bigint").alias("line_no"))


@reg.add("t7_drop_leading", "with p as (select edition_id as book, row_number() over (partition by edition_id order by ch_idx, pos) - 1 as pos, text from (select edition_id, ch_idx, unnest(range(len(paragraphs))) as pos, unnest(paragraphs) as text from chapter) where text is not null) select book, count(*) as n, min(pos) as first from p where pos >= 7 group by 1")
def t7(spark, d):
    p = paras(spark, d).withColumn("p", F.row_number().over(Window.partitionBy("edition_id").orderBy("ch_idx", "pos")) - 1).select(F.col("edition_id").alias("book"), F.col("p").cast("bigint").alias("pos"))
    return tr.drop_leading(p, 7).groupBy("book").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@reg.add("t8_over_limit", f"with {PARAS} select edition_id as book, count(*) as n from paras group by 1 having count(*) > 90")
def t8(spark, d):
    return tr.over_limit(paras(spark, d).withColumnRenamed("edition_id", "book"), limit=90)


@reg.add("t9_t10_sample_window", "select edition_id, 7 % paragraphs as page, greatest(cast(round_even(7.0 / 12 * paragraphs, 0) as bigint) - 3, 0) as first, least(cast(round_even(7.0 / 12 * paragraphs, 0) as bigint) + 5, paragraphs) as stop from edition where paragraphs > 0")
def t9(spark, d):
    e = table(spark, d, "edition").filter("paragraphs > 0")
    first, stop = tr.positional_window(F.lit(7), F.lit(12), F.col("paragraphs").cast("bigint"), 2, 3)
    return e.select("edition_id", tr.page_of(F.col("paragraphs"), F.lit(7)).alias("page"), first.alias("first"), stop.alias("stop"))
