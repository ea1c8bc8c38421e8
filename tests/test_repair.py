"""Repair operators on small cases: what they mend, and what they must leave."""

from pyspark.sql import functions as F

from lectern.operators import repair as rp
from lectern.plans.registry import lines_of


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc bigint, text string")


def col(df, name):
    return [r[name] for r in df.orderBy("doc", "line_no").collect()]


def test_ligatures_and_page_marks(spark):
    df = spark.createDataFrame([("ﬁn de l'aﬀaire [Pg 9]",), ("plain",), (None,), ("",)], "t string")
    a, n = rp.expand_ligatures(F.col("t"))
    b, m = rp.remove_page_marks(F.col("t"))
    rows = df.select(a.alias("a"), n.alias("n"), b.alias("b"), m.alias("m")).collect()
    assert rows[0].a.startswith("fin de l'affaire") and rows[0].n == 2 and rows[0].m == 1 and "[Pg" not in rows[0].b
    assert (rows[1].a, rows[1].n) == ("plain", 0) and rows[2].a is None and rows[3].a == ""


def test_dehyphenation_is_a_fold():
    assert rp.dehyphenate_lines(["une fe-", "nêtre ou-", "verte la nuit"]) == (["une fenêtre", "ouverte", "la nuit"], 2)
    assert rp.dehyphenate_lines(["Jean-", "Pierre vint"]) == (["Jean-", "Pierre vint"], 0)
    assert rp.dehyphenate_lines(["a-", " bas"]) == (["a-", " bas"], 0)
    assert rp.dehyphenate_lines([""]) == ([""], 0)


def test_split_headings(spark):
    got = rp.rejoin_headings(lines_of(texts(spark, "CHAPTER\n\nIV\ntext", "Chapitre.\n\n\nII", "chapter\nof his life\n\nI", "chapter\n\n\n\nV")))
    rows = got.filter("joined").orderBy("doc").collect()
    assert [(r.doc, r.line) for r in rows] == [(0, "CHAPTER IV"), (1, "Chapitre. II")]
    assert got.filter("doc = 0").count() == 2


def test_unfuse_and_indent(spark):
    long = "x" * 50
    df = texts(spark, f"{long}\nIt ended.\n“Then it began\n{long}\n{long}")
    assert rp.unfuse(lines_of(df)).filter("breaks").select("line_no").collect()[0].line_no == 1
    flush = "\n".join(["   Un début ici", "suite de ligne", "suite de ligne"] * 5)
    marks = rp.indent_marks(lines_of(texts(spark, flush, "a\nb", "", "   centred\nplain\nplain\nplain\nplain\nplain\nplain\nplain\nplain\nplain\nplain\nplain")))
    assert [r.mark for r in marks.orderBy("doc").collect()] == [2, 0, 0]
    assert rp.split_on_indent(lines_of(texts(spark, flush))).filter("starts").count() == 4


def test_blocks_keep_prose_and_name_what_goes(spark):
    t = "Micro, 1877, tome 21 (p. 105-122)\n\n(1752)\n\nIl s'appelait[1] Micro\n12\n\n* * *\n\n[1] une note\nqui va\n\nDit en (1802)\n\n(1802)"
    rows = rp.build_blocks(texts(spark, t)).orderBy("block").collect()
    assert [r.kind for r in rows] == ["citation", "year", None, "not prose", "note text", None, None]
    assert rows[2].lines == ["Il s'appelait Micro"]


def test_notes_need_a_reference_or_a_counting_end(spark):
    p = [(0, 0, "He came[3] home"), (0, 1, "[3] A note"), (0, 2, "4. A list alone"), (0, 3, "more"), (0, 4, "1. End"), (0, 5, "2. End"), (1, 0, "1. Alone")]
    df = spark.createDataFrame(p, "doc bigint, pos int, text string")
    got = {(r.doc, r.pos): r.note for r in rp.remove_notes(df).collect()}
    assert got == {(0, 0): None, (0, 1): 3, (0, 2): None, (0, 3): None, (0, 4): 1, (0, 5): 2, (1, 0): None}
    assert rp.unfuse_notes("FIN [1] - Un. [2] Deux. [3] Trois.") == ("FIN", ["[1] - Un.", "[2] Deux.", "[3] Trois."])
    assert rp.unfuse_notes("a [1] b [2] c")[1] == [] and rp.unfuse_notes("[2] b [3] c [4] d")[1] == []


def test_run_together(spark):
    rows = [(1, k, "the first page of the book first page") for k in range(3)] + [(1, 9, "thefirst thing, notebook")]
    df = spark.createDataFrame(rows, "doc bigint, pos int, text string")
    joins = rp.run_together(df)
    assert [(r.word, r.left, r.right) for r in joins.collect()] == [("thefirst", "the", "first")]
    assert [r.pos for r in rp.suspects(df, joins).collect()] == [9]


def test_respacing_never_changes_a_letter(spark):
    rows = [("isvery good", "is very good"), ("isvery", "is vary"), ("a “b”c", 'a "b" c'), ("same", "same"), ("x y", ""), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(rp.respaced(F.col("a"), F.col("b"))).collect()]
    assert got == ["is very good", None, "a “b” c", None, None, None]


def test_boilerplate(spark):
    kept, gone = rp.strip_boilerplate(lines_of(texts(spark, "Lire\nprose\n◄ I\n​\nune œuvre du domaine public\n↑ note\nsuite")))
    assert col(kept, "line") == ["prose"]
    assert [r.kind for r in gone.orderBy("line_no").collect()] == ["menu", "navigation", "invisible", "notice", "note apparatus", "note apparatus"]


def test_removed_and_kept_make_the_input(spark):
    df = lines_of(texts(spark, "Lire\na\nb", "x", ""))
    kept, gone = rp.strip_boilerplate(df)
    assert kept.count() + gone.count() == df.count()
    assert rp.strip_boilerplate(df.filter("false"))[0].count() == 0
