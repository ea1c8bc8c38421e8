"""Queries of alignment. Scores are quantised to millionths on both sides, so that paths are exact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.numbers import chapter_number
from lectern.functions.text import content_hash as h
from lectern.functions.text import dot
from lectern.operators import align as al
from lectern.operators import kernels as kn
from lectern.operators import merge as mg
from lectern.operators.structure import number_tokens_udf
from lectern.plans.registry import Registry, sql_hash
from lectern.plans.structure_queries import sql_num
from lectern.session import table, written

reg = Registry()
queries, oracle_sql = lambda: dict(reg.queries), lambda: dict(reg.sql)

# --- inputs: paired editions, chapters, paragraphs --------------------------------------

PAIRS = "pairs as (select distinct fr_edition_id as book, en_edition_id as en from alignment_report)"
CHAPTERS = f"""{PAIRS}, ch as (select *, {sql_num('number_token')} as num from chapter),
    lc as (select p.book, ch_idx, part_no as part, num, chapter_id from pairs p join ch on ch.edition_id = p.book),
    rc as (select p.book, ch_idx, part_no as part, num, chapter_id from pairs p join ch on ch.edition_id = p.en)"""
#: Sentences of both sides of each book in one order.
SIDES = f"""{CHAPTERS}, ls as (select book, row_number() over (partition by book order by ch_idx, p_idx, s_idx, sent_id) - 1 as pos, text, ch_idx, num from lc join sentence using (chapter_id)),
    rs as (select book, row_number() over (partition by book order by ch_idx, p_idx, s_idx, sent_id) - 1 as pos, text, ch_idx, num from rc join sentence using (chapter_id))"""


def paired_editions(spark, d):
    return table(spark, d, "alignment_report").select(F.col("fr_edition_id").alias("book"), F.col("en_edition_id").alias("en")).distinct()


def both_chapters(spark, d):
    pairs = paired_editions(spark, d)
    c = table(spark, d, "chapter").select("edition_id", "ch_idx", F.col("part_no").alias("part"), chapter_number(F.col("number_token")).alias("num"), "chapter_id")
    left = pairs.join(c, pairs.book == c.edition_id).select("book", "ch_idx", "part", "num", "chapter_id")
    right = pairs.join(c, pairs.en == c.edition_id).select("book", "ch_idx", "part", "num", "chapter_id")
    return left, right


def both_sides(spark, d):
    s = table(spark, d, "sentence").select("chapter_id", "p_idx", "s_idx", "sent_id", "text")
    w = Window.partitionBy("book").orderBy("ch_idx", "p_idx", "s_idx", "sent_id")
    return tuple(c.join(s, "chapter_id").withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select("book", "pos", "text", "ch_idx", "num") for c in both_chapters(spark, d))


@reg.add("j1_lookup", f"with last as (select h, arg_max(text, (seen_at, chapter_id, lang)) as v from unit group by h) select s.sent_id, coalesce(l.v, '') as value from sentence s left join last l on l.h = {sql_hash('s.text')}")
def j1(spark, d):
    u = table(spark, d, "unit").select("h", F.struct("seen_at", "chapter_id", "lang").alias("pos"), F.col("text").alias("value"))
    s = table(spark, d, "sentence").select("sent_id", h(F.col("text")).alias("h"))
    return al.lookup(s, u).select("sent_id", "value")


@reg.add("j2_pair_by_number", f"with {CHAPTERS}, f as (select book, part, num, min(ch_idx) as other from rc where num is not null group by all) select l.book, l.ch_idx, l.num, f.other from lc l left join f on f.book = l.book and f.part is not distinct from l.part and f.num = l.num")
def j2(spark, d):
    left, right = both_chapters(spark, d)
    return al.pair_by_number(left, right).select("book", "ch_idx", F.col("num").cast("bigint").alias("num"), "other")


@reg.add("j3_shared_starts", f"with {SIDES} select a.book, a.num, a.l, b.r from (select book, num, min(pos) as l from ls where num is not null group by all) a join (select book, num, min(pos) as r from rs where num is not null group by all) b using (book, num)")
def j3(spark, d):
    left, right = both_sides(spark, d)
    return al.shared_starts(left, right).withColumn("num", F.col("num").cast("bigint"))


STOP = "[" + ",".join(f"'{w}'" for w in al.STOPWORDS) + "]"
#: The pivot: the text's own lines against the held-out items, a containment join by source.
PIVOT = f"""l as (select source as g, doc_id * 100000 + line_no as id, list_distinct(list_filter(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as t from (select source, doc_id, unnest(range(len(a))) as line_no, unnest(a) as line from (select source, doc_id, string_split(text, chr(10)) as a from documents where text is not null))),
    r as (select source as g, item_id as id, t from (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as t from eval_item), (select distinct source from documents where text is not null)),
    hits as (select a.g, a.id as l, b.id as r, a.nl, b.nr from (select g, id, len(t) as nl, unnest(t) as w from l) a join (select g, id, len(t) as nr, unnest(t) as w from r) b on a.g = b.g and a.w = b.w),
    sim as (select g, l, r, count(*) as shared, count(*) / least(any_value(nl), any_value(nr)) as score from hits group by g, l, r having count(*) >= 2)"""


def document_lines(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select(F.coalesce("source", F.lit("")).alias("group"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select("group", (F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), "doc_id", "text")


@reg.add("q_coverage_containment", f"with {PIVOT.replace('source as g', chr(39) + chr(39) + ' as g').replace(', (select distinct source from documents where text is not null)', '')}, best as (select l, max(round(score, 6)) as s from sim group by 1), n as (select count(*) as total from l) select total, count(case when s >= 0.34 then 1 end) as covered, round(count(case when s >= 0.34 then 1 end) / total, 6) as coverage, count(case when s >= 0.34 then 1 end) / total < 0.7 as degraded from n left join best on true group by total")
def q_coverage(spark, d):
    """Lines of the corpus that hold a third of a held-out item's words: containment join, best match, coverage."""
    lines = document_lines(spark, d).withColumn("group", F.lit(""))
    items = table(spark, d, "eval_item").select(F.lit("").alias("group"), F.col("item_id").alias("id"), "text")
    best = al.containment(lines, items, stated=True).groupBy("l").agg(F.max(F.round("score", 6)).alias("s"))
    rows = lines.select(F.col("id").alias("l")).join(best, "l", "left")
    n = rows.agg(F.count("*").alias("total"), F.count_if(F.col("s") >= al.FLOOR).alias("covered"))
    share = F.col("covered") / F.col("total")
    return n.select("total", "covered", F.round(share, 6).alias("coverage"), (share < al.COVERAGE).alias("degraded"))


@reg.add("j4_containment", f"""with {SIDES}, t as (select book, pos, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as t from ls), u as (select book, pos, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as t from rs)
    select a.book, a.pos as l, b.pos as r, len(list_intersect(a.t, b.t)) as shared, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) as score from t a join u b using (book) where len(list_intersect(a.t, b.t)) >= 2""")
def j4(spark, d):
    left, right = (s.select(F.col("book").alias("group"), F.col("pos").alias("id"), "text") for s in both_sides(spark, d))
    return al.containment(left, right).select(F.col("group").alias("book"), "l", "r", "shared", F.round("score", 6).alias("score"))


#: A grid of small chapters: sides are the embeddings' parity, groups their labels.
GRID = """v as (select label, vec_id % 2 as side, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 as pos, embedding from embeddings),
    grid as (select a.label as g, a.pos as l, b.pos as r, cast(round(list_dot_product(a.embedding::double[], b.embedding::double[]) * 1e6) as bigint) as s from v a join v b on a.label = b.label and a.side = 0 and b.side = 1),
    sizes as (select g, max(l) + 1 as n, max(r) + 1 as m from grid group by 1)"""


def grid(spark, d):
    w = Window.partitionBy("label", "side").orderBy("vec_id")
    v = table(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 2).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    a = v.filter("side = 0").select(F.col("label").alias("group"), F.col("pos").alias("l"), F.col("embedding").alias("ea"))
    b = v.filter("side = 1").select(F.col("label").alias("group"), F.col("pos").alias("r"), F.col("embedding").alias("eb"))
    g = a.join(b, "group").select("group", "l", "r", F.round(dot(F.col("ea"), F.col("eb")) * 1e6).cast("bigint").alias("score"))
    sizes = g.groupBy("group").agg((F.max("l") + 1).alias("n"), (F.max("r") + 1).alias("m"))
    return g, sizes


#: Running-maximum recurrence row by row; right rows take left columns.
MONOTONE = """with recursive {grid}, sc as (select g, r as i, l as j, {score} as s from {cells}), dim as (select g, {rows} as n, {cols} as m from sizes),
    best(g, i, j, b) as (select g, -1, j, 0::bigint from (select distinct g, j from sc) union all
      select g, i, j, max(c) over (partition by g, i order by j) from (select best.g, best.i + 1 as i, best.j, best.b + sc.s as c from best join sc on sc.g = best.g and sc.i = best.i + 1 and sc.j = best.j)),
    path(g, i, j) as (select g, n - 1, (select min(j) from best x where x.g = dim.g and x.i = n - 1 and x.b = (select max(b) from best y where y.g = dim.g and y.i = n - 1)) from dim union all
      select p.g, p.i - 1, (select min(x.j) from best x where x.g = p.g and x.i = p.i - 1 and x.j <= p.j and x.b = (select max(y.b) from best y where y.g = p.g and y.i = p.i - 1 and y.j <= p.j)) from path p where p.i > 0)"""


@reg.add("j6_embedding_align", MONOTONE.format(grid=GRID, score="s", cells="grid", rows="m", cols="n") + ' select g as "group", i as r, j as l from path')
def j6(spark, d):
    g, sizes = grid(spark, d)
    return al.align_scores(g, sizes.select("group", F.col("m").alias("n"), F.col("n").alias("m")))


@reg.add("j5_pivot_align", MONOTONE.format(grid=GRID, score="greatest(s, 100000)", cells="grid", rows="m", cols="n") + ' select path.g as "group", path.i as r, case when sc0.s >= 100000 then path.j end as l from path join (select g, r, l, s from grid) sc0 on sc0.g = path.g and sc0.r = path.i and sc0.l = path.j')
def j5(spark, d):
    """The pivot's rule on the grid: every cell counts the floor at least, weak placements are dropped."""
    g, sizes = grid(spark, d)
    return al.align_scores(g, sizes.select("group", F.col("m").alias("n"), F.col("n").alias("m")), floor=100000)


@reg.add("j5_pivot_texts")
def j5_texts(spark, d):
    """Published sentences on the pivot's sentences of the same chapter number, by shared words."""
    left, right = both_sides(spark, d)
    key = F.concat_ws("/", F.col("book"), F.coalesce(F.col("num"), F.lit(0)))
    part = lambda s: s.withColumn("g", key).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1).select(F.col("g").alias("group"), F.col("k").cast("bigint").alias("id"), "text")
    left, right = part(left), part(right)
    sizes = right.groupBy("group").agg(F.count("*").alias("n")).join(left.groupBy("group").agg(F.count("*").alias("m")), "group")
    scores = al.containment(left, right).join(sizes.select("group"), "group", "left_semi")
    return al.align_scores(scores, sizes, floor=al.FLOOR)


@reg.add(
    "j7_nearest_in_order",
    f"""with recursive {GRID}, med as (select g, l, median(s) + 380000 as floor from grid group by all),
    w(g, l, start, hit) as (select g, -1::bigint, 0::bigint, null::bigint from sizes union all
      select w.g, w.l + 1, case when c.s >= med.floor then c.r else w.start end, case when c.s >= med.floor then c.r end from w join med on med.g = w.g and med.l = w.l + 1
        join lateral (select arg_max(grid.r, (grid.s, -grid.r)) as r, max(grid.s) as s from grid where grid.g = w.g and grid.l = w.l + 1 and grid.r >= w.start) c on true)
    select g as "group", l, hit as r from w where hit is not null""",
)
def j7(spark, d):
    g, sizes = grid(spark, d)
    return al.nearest_in_order(g, sizes, 380000)


MUTUAL = f"with {GRID}, k as (select *, row_number() over (partition by g, l order by s desc, r) as kl, row_number() over (partition by g, r order by s desc, l) as kr from grid), mutual as (select g, l, r, s from k where kl = 1 and kr = 1 and s >= 150000)"


@reg.add("j8_mutual_best", MUTUAL + ' select g as "group", l, r, s as score from mutual')
def j8(spark, d):
    return al.mutual_best(grid(spark, d)[0], 150000)


@reg.add(
    "j9_opening_cut",
    MUTUAL + """, o as (select g, l, r, l - lag(l) over w as dl, r - lag(r) over w as dr from mutual window w as (partition by g order by l, r)),
    n as (select *, sum(case when dl > 0 and dr > 0 and least(dl, dr) = 1 then 0 else 1 end) over (partition by g order by l, r) as run from o)
    select g as "group", first[1] as l, first[2] as r from (select g, min(start) as first from (select g, run, min((l, r)) as start from n group by all having count(*) >= 3) group by g)""",
)
def j9(spark, d):
    return al.opening_cut(al.mutual_best(grid(spark, d)[0], 150000))


@reg.add(
    "j9_opening_matter",
    MUTUAL.replace("150000", "(select median(s) + 100000 from grid x where x.g = k.g)")
    + """, o as (select g, l, r, l - lag(l) over w as dl, r - lag(r) over w as dr from mutual window w as (partition by g order by l, r)),
    n as (select *, sum(case when dl > 0 and dr > 0 and least(dl, dr) = 1 then 0 else 1 end) over (partition by g order by l, r) as run from o),
    cut as (select g, first[1] as l, first[2] as r from (select g, min(start) as first from (select g, run, min((l, r)) as start from n group by all having count(*) >= 3) group by g)),
    held as (select v.label as g, v.side, case when sum(case when v.pos < case when v.side = 0 then c.l else c.r end then 10 + v.pos % 7 else 0 end) <= sum(10 + v.pos % 7) * 0.25 then any_value(case when v.side = 0 then c.l else c.r end) else 0 end as held_at from v join cut c on c.g = v.label group by v.label, v.side)
    select g as "group", coalesce(max(case when side = 0 then held_at end), 0) as l, coalesce(max(case when side = 1 then held_at end), 0) as r from held group by g""",
)
def j9_matter(spark, d):
    """What stands before two editions first run together: agreements over the grid's own median, drops held to a quarter."""
    g, sizes = grid(spark, d)
    n = sizes.select("group", F.explode(F.create_map(F.lit("l"), F.col("n"), F.lit("r"), F.col("m"))).alias("side", "k"))
    chars = n.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select("group", "side", "pos", (10 + F.col("pos") % 7).alias("chars"))
    return al.opening_matter(g, chars, margin=100_000)


@reg.add("j10_content_pairs")
def j10(spark, d):
    """Groups' rows paired one to one in order by content (an LCS-shaped program; tested by brute force)."""
    g, sizes = grid(spark, d)
    return al.content_pairs(g, sizes)


@reg.add("j11_numbering_check", f"""with {GRID}, e as (select a.g, a.l, any_value(a.s) as own, max(b.s) as other from grid a join grid b on b.g = a.g and b.l = a.l and abs(b.r - a.l) = 1 where a.l = a.r group by a.g, a.l)
    select g as "group", count(*) as checked, count(case when other > own then 1 end) as wrong, count(*) < 4 or count(case when other > own then 1 end) <= count(*) * 0.25 as trusted from e group by g""")
def j11(spark, d):
    return al.numbering_check(grid(spark, d)[0])


@reg.add("j12_j24_strategy", f"""with {CHAPTERS}, a as (select book, count(*) as n, count(num) as k from lc group by 1), b as (select book, count(*) as n, count(num) as k from rc group by 1)
    select book, case when a.k >= 2 and b.k >= 2 and a.k >= a.n * 0.8 and b.k >= b.n * 0.8 then 'number' when least(a.n, b.n) >= 3 and least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 then 'content' else 'book' end as pairing, case when a.k > 0 and b.k > 0 then 'numbered' else 'proportional' end as method from a join b using (book)""")
def j12(spark, d):
    left, right = both_chapters(spark, d)
    a = left.groupBy("book").agg(F.count("*").alias("an"), F.count("num").alias("ak"))
    b = right.groupBy("book").agg(F.count("*").alias("bn"), F.count("num").alias("bk"))
    pairing = al.pairing_strategy(F.col("an"), F.col("bn"), F.col("ak"), F.col("bk"), F.lit(True))
    method = al.alignment_strategy(F.lit(False), F.lit(False), F.col("ak"), F.col("bk"), F.lit(0))
    return a.join(b, "book").select("book", pairing.alias("pairing"), method.alias("method"))


AGREE = rf"""{SIDES}, lt as (select distinct book, pos, substring(w, 1, 6) as token from (select book, pos, unnest(string_split(regexp_replace(lower(strip_accents(array_to_string(regexp_extract_all(text, '\p{{L}}{{2,}}|\d{{2,}}'), ' '))), '[^a-z0-9]+', ' ', 'g'), ' ')) as w from ls) where length(w) >= 4),
    rt as (select distinct book, pos, substring(w, 1, 6) as token from (select book, pos, unnest(string_split(regexp_replace(lower(strip_accents(array_to_string(regexp_extract_all(text, '\p{{L}}{{2,}}|\d{{2,}}'), ' '))), '[^a-z0-9]+', ' ', 'g'), ' ')) as w from rs) where length(w) >= 4),
    lk as (select *, count(*) over (partition by book, token) as n, row_number() over (partition by book, token order by pos) as k from lt), rk as (select *, count(*) over (partition by book, token) as n, row_number() over (partition by book, token order by pos) as k from rt),
    agree as (select distinct a.book, a.pos as l, b.pos as r from lk a join rk b using (book, token, n, k) where n <= 3)"""


@reg.add("j13_rare_agreements", f"with {AGREE} select * from agree")
def j13(spark, d):
    left, right = both_sides(spark, d)
    return al.rare_agreements(left, right)


@reg.add("j14_longest_run", f"""with recursive {AGREE}, o as (select book, l, r, row_number() over (partition by book order by l, r) as k from agree),
    piles(book, k, tails) as (select book, 0::bigint, []::bigint[] from (select distinct book from o) union all
      select p.book, p.k + 1, list_concat(p.tails[1:len(list_filter(p.tails, lambda x: x <= o.r))], [o.r], p.tails[len(list_filter(p.tails, lambda x: x <= o.r)) + 2:]) from piles p join o on o.book = p.book and o.k = p.k + 1)
    select book, len(arg_max(tails, k)) as n from piles group by book""")
def j14(spark, d):
    """How long the longest run of agreements is that goes back on neither side."""
    left, right = both_sides(spark, d)
    return al.longest_run(al.rare_agreements(left, right)).groupBy("book").agg(F.count("*").alias("n"))


@reg.add("j15_anchored_texts")
def j15(spark, d):
    """Each French sentence's English text from pins and the gaps between them, with the chapters' starts as pins."""
    left, right = both_sides(spark, d)
    pins = al.rare_agreements(left, right).unionByName(al.shared_starts(left, right).select("book", "l", "r")).distinct()
    runs = al.longest_run(written(pins, "pins")).withColumnRenamed("book", "group")
    return al.anchored_texts(left.withColumnRenamed("book", "group"), right.withColumnRenamed("book", "group"), runs)


@reg.add("j16_share_out", f"with {CHAPTERS}, a as (select book, count(*) as f from lc group by 1), b as (select book, count(*) as p from rc group by 1), x as (select book, f, p, unnest(range(f)) as i from a join b using (book)) select book, i, case when f = p then i else least(i * p // f, p - 1) end as first, case when f = p then i + 1 else least(greatest(least(i * p // f, p - 1) + 1, (i + 1) * p // f), p) end as stop from x")
def j16(spark, d):
    """Chapters of one edition shared out over the other's in proportion: integer slices."""
    left, right = both_chapters(spark, d)
    n = left.groupBy("book").agg(F.count("*").alias("n")).join(right.groupBy("book").agg(F.count("*").alias("m")), "book")
    return al.shared_spans(n)


def chapter_groups(spark, d):
    left, right = both_sides(spark, d)
    key = F.concat_ws("/", F.col("book"), F.coalesce(F.col("num"), F.lit(0)))
    return tuple(s.select(key.alias("group"), "pos", "text") for s in (left, right))


@reg.add("j17_j18_match_by_length")
def j17(spark, d):
    """English text for each French sentence of a chapter by length alone: shared out or poured."""
    return al.place_texts(*chapter_groups(spark, d))


@reg.add("j19_shape_beads")
def j19(spark, d):
    """English text for each French sentence of a chapter by length beads (Gale and Church)."""
    return al.place_texts(*chapter_groups(spark, d), kn.shape_spread)


@reg.add("j20_j21_chapter_flow")
def j20(spark, d):
    """English text for each French sentence of a chapter, level at shared names, numbers and both ends."""
    return al.place_texts(*chapter_groups(spark, d), al.chapter_flow)


@reg.add("j22_book_anchors")
def j22(spark, d):
    """Whole-book anchors with number tokens besides words: the run for each book."""
    left, right = both_sides(spark, d)
    return al.longest_run(al.rare_agreements(left, right, number_tokens_udf))


@reg.add("j26_live_sessions", "select distinct a.account_id, a.book_id from shelf_change a join (select book_id, max(received_at) as until from shelf_change group by 1) b using (book_id) where b.until > timestamp '2023-06-01' and a.received_at <= b.until")
def j26(spark, d):
    """Rows joined with what has not expired at a moment."""
    s = table(spark, d, "shelf_change")
    sessions = s.groupBy("book_id").agg(F.max("received_at").alias("expires_at"))
    live = mg.live_sessions(sessions, F.lit("2023-06-01").cast("timestamp_ntz"))
    return s.join(live, "book_id").filter("received_at <= expires_at").select("account_id", "book_id").distinct()


@reg.add("j27_not_cached", f"select sent_id from sentence s anti join unit u on u.h = {sql_hash('s.text')}")
def j27(spark, d):
    s = table(spark, d, "sentence").select("sent_id", h(F.col("text")).alias("h"))
    return s.join(table(spark, d, "unit").select("h").distinct(), "h", "left_anti").select("sent_id")
