"""Repeated site lines against a plain count; look-alike texts against Unicode's own normaliser."""

import random
import re
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import p2_sitelines as p2
from lectern.llm import p3_lookalike as p3

CHAPTERS, EDITIONS = "chapter_id bigint, edition_id bigint, paragraphs array<string>, source string", "edition_id bigint, source string"


def sites(n=60, seed=2):
    rng = random.Random(seed)
    notices = ["Partagez ce chapitre avec vos amis", "LU  {} FOIS depuis le début", "Courte", "Tous droits réservés ici"]
    rows = []
    for c in range(n):
        lines = [rng.choice(notices).format(rng.randrange(99)) if rng.random() < 0.4 else f"une phrase propre numéro {'abcdefghij'[rng.randrange(10)] * 3}" for _ in range(6)]
        rows.append((c, rng.choice([0, 0, 0, 1, 2, 9, None]), ["\n".join(lines[:3]), None, "", *lines[3:]], None))
    return rows, [(0, "big"), (1, "small"), (2, None)]


def brute(rows, editions):
    source, held, where = dict(editions), defaultdict(set), []
    for c, e, ps, _ in rows:
        if source.get(e) is None:
            continue
        for p, t in enumerate(ps or []):
            for j, line in enumerate((t or "").split("\n") if t is not None else []):
                key = re.sub(r"[^\w]|[\d_]", "", line.lower())
                if len(key) >= 12:
                    held[source[e], key].add(c)
                    where.append((source[e], key, c, p, j))
    return {(c, p, j) for s, k, c, p, j in where if len(held[s, k]) >= 6}


def test_lines_equal_a_plain_count_for_any_split(spark):
    rows, editions = sites()
    c, e = spark.createDataFrame(rows, CHAPTERS), spark.createDataFrame(editions, EDITIONS)
    want = brute(rows, editions)
    assert want
    for parts in (1, 4):
        assert {tuple(r) for r in p2.repeated_lines(c, e, parts).collect()} == want


def test_a_delta_rebuilds_only_newly_crossed_chapters(spark):
    from lectern.session import work_path

    line = "Partagez ce chapitre avec vos amis"
    lines = lambda a, b: p2.chapter_lines(spark.createDataFrame([(k, 1, [line], None) for k in range(a, b)], CHAPTERS)).select("chapter_id", F.lit("s").alias("source"), "lines")
    site = p2.SiteLines(spark, work_path(spark, "t"))
    for a, b in ((0, 4), (2, 5), (5, 7), (7, 8)):
        site.merge(lines(a, b))
    got = [sorted(r.chapter_id for r in site.removed(k).collect()) for k in range(4)]
    assert got == [[], [], [0, 1, 2, 3, 4, 5, 6], [7]]


def test_empty_tables(spark):
    assert p2.repeated_lines(spark.createDataFrame([], CHAPTERS), spark.createDataFrame([], EDITIONS)).count() == 0


def test_looks():
    same = [("ﬁn", "fin"), ("ｄéｆ", "déf"), ("e\u0301te\u0301", "été"), ("a\u200bb\u00ad", "ab"), ("a\u00a0b\u2009c", "a b c"), ("раgе", "page"), ("Νο", "No"), ("a\u0323\u0307", "ạ\u0307"), ("a\u0307\u0323", "ạ\u0307")]
    other = [("a.", "a?"), ("e", "é"), ("The", "THe"), ("a b", "b a"), ("…", "..."), ("x²", "x2"), ("дом", "dom")]
    for a, b in same:
        x, y = p3.skeletons([a, b])
        assert x == y, (a, b)
    for a, b in other:
        x, y = p3.skeletons([a, b])
        assert x != y, (a, b)
    assert p3.skeletons([None, ""]) == [None, ""]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeoAé\u0300\u0301\u0302\u0308\u0327\u0323ëçñ x", max_size=12))
def test_accents_compose_as_unicode_does(text):
    got = p3.skeletons([text])[0]
    assert got == unicodedata.normalize("NFC", text) and p3.skeletons([got]) == [got]


def test_true_words_of_other_scripts_stay():
    russian, greek = "Норвел долго смотрел на реку", "Ο Νορβέλ κοίταζε το ποτάμι"
    assert p3.canonical([russian])[0].split()[1] == "долго" and "κοίταζε" in p3.canonical([greek])[0]
    mixed = "Hорвел дoлго"  # Latin H and o inside Russian words
    assert p3.canonical([mixed])[0] == p3.canonical(["Норвел долго"])[0]


def test_pairs(spark):
    rows = [("h1", "une fin"), ("h2", "une ﬁn"), ("h3", "une fin."), ("h1", "une fin"), ("h4", None), (None, "une fin"), ("h5", "unе fin")]
    df = spark.createDataFrame(rows, "h string, text string").withColumn("look", F.lit(1))
    looks = p3.look_classes(df).collect()
    groups = defaultdict(set)
    for r in looks:
        groups[bytes(r.look)].add(r.h)
    assert sorted(map(sorted, groups.values())) == [["h1", "h2", "h5"], ["h3"]]


def test_syllables_ideographs_and_numerals_have_one_form():
    for a, b in (("한국 글", unicodedata.normalize("NFD", "한국 글")), ("\uf900\U0002f800", unicodedata.normalize("NFC", "\uf900\U0002f800")), ("Ⅻ ⅰ", "XII i")):
        assert a != b and p3.skeletons([a]) == p3.skeletons([b])
    assert p3.skeletons(["한국"]) == ["한국"] and p3.skeletons(["한"]) != p3.skeletons(["핝"])
