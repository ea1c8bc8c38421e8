"""Alignment joins, annotation, enrichment, merges, sources and finished books on small cases."""

import io
import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import align as al
from lectern.operators import annotate as an
from lectern.operators import enrich as en
from lectern.operators import merge as mg
from lectern.operators import metrics as mt
from lectern.plans import render as rd
from lectern.sources import files as fl
from lectern.sources import library as lb


def test_pairing_by_number_with_null_parts(spark):
    c = "book int, ch_idx int, part int, num int"
    left = spark.createDataFrame([(1, 0, None, None), (1, 1, None, 1), (1, 2, None, 2), (1, 3, 2, 1)], c)
    right = spark.createDataFrame([(1, 5, None, 1), (1, 6, None, 1), (1, 7, 2, 1), (1, 8, None, None)], c)
    assert {(r.ch_idx, r.other) for r in al.pair_by_number(left, right).collect()} == {(0, None), (1, 5), (2, None), (3, 7)}


def test_rare_agreements(spark):
    t = "book int, pos int, text string"
    left = spark.createDataFrame([(1, 0, "Élodie vint en 1815"), (1, 1, "rien"), (1, 2, "Micromégas dit"), (1, 3, None)], t)
    right = spark.createDataFrame([(1, 0, "nothing"), (1, 1, "Elodie came in 1815"), (1, 2, "Micromegas spoke to Micromegas"), (1, 3, "")], t)
    assert {(r.l, r.r) for r in al.rare_agreements(left, right).collect()} == {(0, 1), (2, 2)}


def test_mutual_best_and_opening(spark):
    rows = [(0, i, j, 9 if i == j + 1 else 1) for i in range(6) for j in range(5)]
    s = spark.createDataFrame(rows, "group int, l int, r int, score int")
    m = al.mutual_best(s, 5)
    assert {(r.l, r.r) for r in m.collect()} == {(k + 1, k) for k in range(5)}
    assert [tuple(r) for r in al.opening_cut(m).collect()] == [(0, 1, 0)]
    assert al.opening_cut(m.filter("l < 3")).count() == 0


def test_every_published_paragraph_is_placed_or_dropped(spark):
    s = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 1, 1, 0.1), ("a", 2, 1, 0.8)], "group string, r int, l int, score double")
    n = spark.createDataFrame([("a", 3, 2), ("b", 2, 0)], "group string, n int, m int")
    placed = {(r.group, r.r): r.l for r in al.align_scores(s, n).collect()}
    assert placed == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("b", 0): None, ("b", 1): None}
    assert {(r.group, r.r): r.l for r in al.align_scores(s, n, 0.34).collect()}["a", 1] is None


def test_a_book_against_itself_lies_on_the_diagonal(spark):
    t = [f"Le sieur Nom{chr(65 + k)}{chr(97 + k)}xyz partit. Il revint en {1800 + k}." for k in range(8)]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(t)], "group string, pos bigint, text string")
    got = {r.pos: r.value for r in al.place_texts(df, df, al.chapter_flow).collect()}
    assert got == dict(enumerate(t))


def test_anchor_maps_through_typography():
    text = "L’étoile… dit-il — oui"
    units = [{"surface": "l'étoile", "pos": "n", "gloss": "g", "infinitive": ""}]
    assert an.anchor_units(text, units) is None  # case counts
    units = [{"surface": s, "pos": "n", "gloss": "g", "infinitive": ""} for s in ("L'étoile", "", "...", "- oui")]
    spans = an.anchor_units(text, units)
    assert [text[s["start"] : s["end"]] for s in spans] == ["L’étoile", "…", "— oui"]
    assert an.anchor_units(text, units[::-1]) is None and an.anchor_units(text, []) is None


def test_width_and_coverage(spark):
    cases = {"un jeune homme": False, "citoyens de la terre": True, "Moscovie ou Chine": True, "et la maison": False, "le grand vieux mur": True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", an.too_wide(F.col("s"), F.lit("noun")).alias("w"))
    assert {r.s: r.w for r in df.collect()} == cases
    u = spark.createDataFrame([("ab cd", [(0, 2, "", "", "")]), ("", [])], "t string, u array<struct<start:int,end:int,pos:string,gloss:string,infinitive:string>>")
    assert [r[0] for r in u.select(an.gloss_coverage(F.col("t"), F.col("u"))).collect()] == [0.5, 1.0]


def test_absorb_is_the_same_in_any_order(spark):
    s = "h string, units array<int>"
    replies = [("a", [1]), ("a", []), ("b", []), ("b", [2]), ("c", [])]
    want = {("a", (9,)), ("b", (2,)), ("c", ())}
    for order in itertools.islice(itertools.permutations(replies), 0, 120, 29):
        held = spark.createDataFrame([("a", [9])], s)
        for r in order:
            held = an.absorb(held, spark.createDataFrame([r], s))
        assert {(r.h, tuple(r.units)) for r in held.collect()} == want


def test_marked_replies(spark):
    df = spark.createDataFrame([("@@@1@@@\na “b”\n\nc\n@@@3@@@ \nd\n@@@1@@@\ne",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(an.marked_replies(F.col("t"))).collect()] == [{1: "e", 3: "d"}, None, None]


def test_cache_versions_and_merge(spark, tmp_path):
    path = str(tmp_path / "c")
    assert en.load_cache(spark, path).count() == 0
    a = spark.createDataFrame([("k", "old"), ("x", "1")], "key string, value string").selectExpr("key", "value", "1 as version", "timestamp'2023-01-01' as written_at")
    a.write.parquet(path)
    mine = a.filter("key = 'k'").withColumn("value", F.lit("new"))
    assert {(r.key, r.value) for r in en.merge_caches(en.load_cache(spark, path), mine).collect()} == {("k", "new"), ("x", "1")}
    with pytest.raises(en.CacheVersionError):
        en.load_cache(spark, path, 2)


def test_calls_that_fail_are_rows_still_to_do(spark):
    rows = spark.createDataFrame([(str(k), "bad" if k == 3 else "x" * k) for k in range(6)], "key string, text string").coalesce(1)

    def client(texts):
        if "bad" in texts:
            raise OSError("down")
        return [str(len(t)) for t in texts]

    done = en.call_batches(rows, client, batch=2)
    assert {r.key: r.value for r in done.collect()} == {"0": "1", "1": "1", "4": "4", "5": "5"}
    assert {r.key for r in en.to_do(rows, done).collect()} == {"2", "3"}


def test_replay_and_fold_differ_where_a_partial_change_overtakes(spark):
    c = "account_id int, book_id string, at bigint, arrival bigint, title string, position string"
    df = spark.createDataFrame([(1, "b", 10, 1, None, "p2"), (1, "b", 5, 2, "T", "p1")], c)
    assert [tuple(r)[2:] for r in mg.merge_entries(df, ["title", "position"]).collect()] == [("T", "p2", 10)]
    assert [tuple(r)[2:] for r in mg.replay_entries(df, ["title", "position"]).collect()] == [(10, None, "p2")]


def test_edits_merge_the_same_in_any_order_and_as_a_stream(spark, tmp_path):
    from lectern.streaming.edits import edit_stream

    rows = [(1, "b", f"h{k % 3}", (k * 7) % 5, k, f"t{k}", k) for k in range(20)]
    c = "account_id bigint, book_id string, h string, at bigint, arrival bigint, text string, change_id bigint"
    df = spark.createDataFrame(rows, c)
    want = {(r.h, r.change_id) for r in mg.merge_edits(df).collect()}
    assert want == {(r.h, r.change_id) for r in mg.merge_edits(df.repartition(5).orderBy(F.rand(1))).collect()}
    for k in range(2):
        spark.createDataFrame(rows[k::2], c).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(c).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = edit_stream(stream).writeStream.format("memory").queryName("edits").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("edits").collect():
        last[r.h] = max(last.get(r.h, (-1, -1, None)), (r.at, r.arrival, r.change_id))
    assert {(h, v[2]) for h, v in last.items()} == want


def epub(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_files_of_every_format(spark, tmp_path):
    book = {
        "META-INF__container_DOT_xml": "<container><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></container>",
        "o__p_DOT_opf": "<package xmlns:dc='d'><metadata><dc:title> Un livre </dc:title><dc:language>fr</dc:language></metadata><manifest><item id='b' href='b.html'/><item id='a' href='a.html'/><item id='x' href='no.html'/></manifest><spine><itemref idref='b'/><itemref idref='x'/><itemref idref='a'/></spine></package>",
        "o__a_DOT_html": "<html><head><title>t</title></head><p>second</p></html>",
        "o__b_DOT_html": "<p>first &amp; only<br>line</p><script>no</script>",
    }
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cases = {"a.epub": epub(**book), "b.DOCX": epub(word__document_DOT_xml=f"<w:document xmlns:w='{w}'><w:p><w:r><w:t>Un </w:t><w:t>mot</w:t></w:r></w:p><w:p><w:r><w:t>deux</w:t></w:r></w:p></w:document>"), "c.txt": "﻿été\r\nfin".encode(), "d.txt": "été\rœ".encode("cp1252"), "e.xyz": b"x", "f.epub": b"no zip", "g.txt": b"  "}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in fl.read_files(spark, str(tmp_path)).collect()}
    assert got["a.epub"].text == "first & only\nline\n\nsecond" and (got["a.epub"].title, got["a.epub"].lang) == ("Un livre", "fr")
    assert got["b.DOCX"].text == "Un mot\n\ndeux" and got["c.txt"].text == "été\nfin" and got["d.txt"].text == "été\nœ"
    assert all(got[n].error for n in ("e.xyz", "f.epub", "g.txt"))


def test_page_parsing():
    page = "<h1 class='wst-header-title-text'>Le Puits</h1><p><span class='dropinitial'>N </span>ous étions à l'étude, quand il vint.</p><p>court</p><div class='noprint'><p>une navigation assez longue ici</p></div><p>Il dit enfin un mot. — Et l'autre répondit longuement.</p>"
    title, found = lb.parse_page(page, dashes=True)
    assert title == "Le Puits" and found == ["Nous étions à l'étude, quand il vint.", "Il dit enfin un mot.", "Et l'autre répondit longuement."]
    assert lb.parse_page(None) == (None, []) and lb.parse_page("") == (None, [])


def test_fetches_are_tried_again_then_reported(spark):
    def fetch(page):
        if page == "bad":
            raise OSError("gone")
        return "<p>" + page

    got = {r.page: (r.html, r.error) for r in lb.fetch_pages(spark.createDataFrame([("a",), ("bad",)], "page string"), fetch, waits=(0,)).collect()}
    assert got == {"a": ("<p>a", None), "bad": (None, "gone")}


def test_spreads_cover_each_character_once(spark):
    rows = [("b", k, "mot " * n) for k, n in enumerate((10, 290, 1, 1500, 40, 0))]
    df = spark.createDataFrame(rows, "book string, pos bigint, text string")
    cells = rd.spreads(df, 500).collect()
    for _, pos, text in rows:
        spans = sorted((c.start, c.end) for c in cells if c.pos == pos)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    used = {}
    for c in cells:
        used[c.spread] = used.get(c.spread, 0) + c.end - c.start
    assert max(used.values()) <= 505


def test_a_book_survives_its_file(spark):
    p = spark.createDataFrame([(1, 0, 0, "h1", "a <b> \"c\""), (1, 1, 0, "h2", "é")], "book int, pos bigint, ch_idx int, h string, text string")
    t = spark.createDataFrame([("h1", "x")], "h string, value string")
    pairs = rd.assemble(p, t, t.filter("false"))
    data = rd.book_json(pairs)
    assert "<" not in data.collect()[0].data
    assert sorted(map(tuple, rd.read_back(data).select(pairs.columns).collect())) == sorted(map(tuple, pairs.collect()))


def test_metrics(spark):
    faults = [((100, 300), "one side"), ((100, 0), "empty"), ((150, 160), None), ((900, 200), "lopsided"), ((300, 290), None)]
    df = spark.createDataFrame([f[0] for f in faults], "a int, b int")
    assert [r[0] for r in df.select(mt.spread_fault(F.col("a"), F.col("b"))).collect()] == [f[1] for f in faults]
    old = spark.createDataFrame([(1, 2, None), (2, 5, "x")], "k int, a int, b string")
    new = spark.createDataFrame([(1, 2, None), (2, 6, "x"), (3, 1, None)], "k int, a int, b string")
    assert {tuple(r) for r in mt.drift(old, new, "k", ["a", "b"]).collect()} == {(2, "a", "5", "6"), (3, "a", None, "1")}


def test_absorb_query_covers_every_sentence(spark, tmp_path):
    from lectern.plans import book_queries as bq

    texts = {k: " ".join(f"mot{'abcdefghij'[(k + j) % 10]}" for j in range(2 + k)) for k in range(30)}
    spark.createDataFrame(list(texts.items()), "sent_id bigint, text string").write.parquet(str(tmp_path / "sentence.parquet"))
    rows = bq.queries()["n7_n8_absorb"](spark, str(tmp_path)).collect()
    assert sorted(r.n for r in rows) == [2 + k for k in range(30)]
    assert {r.n for r in rows if r.how == "rescued"} == {len(t.split()) for t in texts.values() if len(t) > 80}


def test_works_are_resolved_through_several_links(spark):
    links = spark.createDataFrame([("A", "B", 0), ("B", "C", 0), ("C", "C/1", 0), ("C", "C/2", 1), ("D", "E", 0), ("F", "A", 0), ("A", "B", 0)], "work string, target string, pos int")
    works = spark.createDataFrame([(x,) for x in "ABCDF"], "work string")
    got = {}
    for r in lb.resolve_work(works, links).collect():
        got.setdefault((r.work, r.shape), []).append(r.page)
    assert {k: sorted(v) for k, v in got.items()} == {("A", "edition"): ["C/1", "C/2"], ("B", "edition"): ["C/1", "C/2"], ("C", "chapters"): ["C/1", "C/2"], ("D", "single"): ["D"], ("F", "single"): ["F"]}
    assert ("F", "edition") in {(r.work, r.shape) for r in lb.resolve_work(works, links, depth=3).collect()}


def test_a_centred_heading_is_lifted_out():
    body = "<p>It was a long and quiet voyage over the northern sea.</p>"
    page = '<div class="wst-center"><p>VOLUME ONE</p></div><p class="wst-center">CHAPTER XIII THE BLACK RIVER</p>' + body
    title, found = lb.parse_page(page)
    assert title == "THE BLACK RIVER" and found == ["It was a long and quiet voyage over the northern sea."]
    plain = "<p>CHAPTER XI was the best of them, said everybody.</p>" + body
    assert lb.parse_page(plain)[0] is None and len(lb.parse_page(plain)[1]) == 2
    stated = '<i data=\'{"current":{"wt":"[[Book/2|The {{sc|Long}} Voyage Home]]"}}\'></i><p>The long voyage home and more.</p>' + body
    assert lb.parse_page(stated) == ("The Long Voyage Home", ["It was a long and quiet voyage over the northern sea."])
