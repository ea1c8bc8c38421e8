"""Structure, trimming and packing on small cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions.numbers import chapter_number, roman_text, roman_value
from lectern.operators import packing as pk
from lectern.operators import structure as sr
from lectern.operators import trim as tr
from lectern.plans.registry import lines_of


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).collect()[0][0]


def test_chapter_numbers(spark):
    cases = {"Chapitre IV": 4, "CHAPTER 12.": 12, "Chapter Twenty-One": 21, "chapitre premier": 1, "dix-septième": 17, "vingt-unième": 21, "trentième": 30, "deuxieme": 2, "premiere": 1, "thirtieth": 30, "cent vingt": 120, "trente et unième": 31, "zero": None, "quatre-vingt-dix": 90, "soixante-dix": 70, "0": None, "IIII": None, "": None, "moon": None, "Chapter XL": 40}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", chapter_number(F.col("t")).alias("n"))
    got = {r.t: r.n for r in df.collect()}
    assert got == cases


def test_romans_round_trip(spark):
    df = spark.range(1, 4000).select("id", roman_value(roman_text(F.col("id"))).alias("b"))
    assert df.filter("id <> b or b is null").count() == 0


def test_number_tokens():
    assert sr.number_tokens("vingt et un hommes, 1815 et deux cents") == ["num200", "num21"]
    assert sr.number_tokens("quatre-vingts ans") == ["num80"] and sr.number_tokens(None) == [] and sr.number_tokens("one man, zéro") == ["num1"]
    assert sr.number_tokens("trois millions deux mille cent vingt et") == ["num3002120"]


def test_sentences_lose_only_spaces(spark):
    text = "Il vint. « Oui ! » dit-il… Puis rien"
    got = one(spark, text, sr.sentences)
    assert "".join(got).replace(" ", "") == text.replace(" ", "") and len(got) == 4
    assert one(spark, "", sr.sentences) == [] and one(spark, "no end", sr.sentences) == ["no end"]
    assert one(spark, "He said: “Go.” She went", sr.speech_pieces) == ["He said:", "“Go.”", "She went"]


def test_ascending_run_prefers_steps_by_one_and_new_parts():
    assert [([1, 2, 5, 3][k]) for k in sr.ascending_run([0, 10, 20, 30], [1, 2, 5, 3])] == [1, 2, 3]
    assert sr.ascending_run([0, 10, 20, 30, 40], [1, 2, 3, 1, 2]) == [0, 1, 2, 3, 4]
    assert sr.ascending_run([0, 1], [5, 1]) == [0] and sr.ascending_run([], []) == []


def test_chapters_of_a_written_and_of_a_bare_book(spark):
    prose = "It was a dark and stormy night again."
    written = "\n".join(["Front words here.", "CHAPTER I", prose, "CHAPTER II", prose, "CHAPTER I", prose])
    bare = "\n".join(["I", prose, "", "II", prose, "", "III", prose, "", "IV", prose])
    none = "just prose\nand more"
    diary = "\n".join(["", "Jeudi.", "", prose, "", "Vendredi :", "", prose, "", "Samedi.", "", prose, ""])
    df = spark.createDataFrame([(0, written), (1, bare), (2, none), (3, diary)], "doc bigint, text string")
    rows = sr.chapters(lines_of(df)).orderBy("doc", "chapter").collect()
    got = {d: [(r.token, r.part) for r in rows if r.doc == d] for d in range(4)}
    assert got[0] == [(None, None), ("I", 1), ("II", 1), ("I", 2)]
    assert got[1] == [("I", None), ("II", None), ("III", None), ("IV", None)]
    assert got[2] == [(None, None)]
    assert [t for t, _ in got[3]][-3:] == ["Jeudi.", "Vendredi :", "Samedi."]


def test_cut_to_shape_equals_the_kernel(spark):
    rng = random.Random(2)
    for _ in range(3):
        pieces = [rng.randrange(1, 60) for _ in range(30)]
        shape = [rng.randrange(1, 200) for _ in range(9)]
        p = spark.createDataFrame([(0, k, n) for k, n in enumerate(pieces)], "book int, k int, size int")
        s = spark.createDataFrame([(0, k, n) for k, n in enumerate(shape)], "book int, k int, size int")
        got = {(r.slot, r.first, r.last) for r in sr.cut_to_shape(p, s).collect()}
        ends, wanted = np.cumsum([n + 1 for n in pieces]), np.cumsum([n + 1 for n in shape])
        at, want = 0, set()
        for k, w in enumerate(wanted):
            stop = len(pieces) if k == len(shape) - 1 else sr.nearest_end(ends, w / wanted[-1] * ends[-1])
            stop = max(stop, at)
            if stop > at:
                want.add((k, at, stop - 1))
            at = stop
        assert got == want


def test_greedy_groups(spark):
    df = spark.createDataFrame([([2, 3, 1, 9, 1, 1, 1],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(pk.greedy_groups(F.col("a"), 4, 2)).collect()] == [[0, 1, 1, 2, 3, 3, 4], [], None]


def test_trim_matter_never_empties_a_book(spark):
    rows = [(1, 0, None, 0, "PRODUCED"), (1, 1, 1, 0, "x" * 50), (1, 2, 2, 0, "y" * 50), (1, 2, 2, 1, "Bibliographie."), (1, 2, 2, 2, "z"), (2, 0, None, 0, "TITLE"), (2, 0, None, 1, "Copyright 1900"), (2, 0, None, 2, "It began."), (3, 0, None, 0, "TITLE")]
    df = spark.createDataFrame(rows, "book int, ch_idx int, num int, p_idx int, text string")
    got = {(r.book, r.ch_idx, r.p_idx) for r in tr.trim_matter(df).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (2, 0, 2), (3, 0, 0)}


def test_pending_takes_the_first_of_each_hash(spark):
    u = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 9), ("a", 1)], "h string, pos int")
    done = spark.createDataFrame([("b",)], "h string")
    assert {(r.h, r.pos) for r in tr.pending(u, done).collect()} == {("a", 1), ("c", 9)}


def test_order_does_not_depend_on_partitions(spark):
    rows = [(0, k, f"line {k}" if k % 7 else "CHAPTER " + str(k // 7 + 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc bigint, line_no int, line string")
    a = sr.parts(sr.explicit_headings(df)).collect()
    b = sr.parts(sr.explicit_headings(df.repartition(7).orderBy(F.rand(3)))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
