"""Compositions: repair against literal texts, builds and alignment end to end on small books."""

from lectern.operators import drivers as dr

TEXTS = "doc bigint, text string, pdf boolean, mark string"


def test_repair_runs_every_step_in_order(spark):
    broken = "\n\n".join(f"{'ordinary words without a close ' * 4}{k}" for k in range(24))
    indented = "\n".join(["   The ﬁrst para-", "graph goes on here and is long enough.", "   Second one says [Pg 12] things", "and closes at last.", "   Third.", "goes on and on until", "it has ended here."] + ["and more of the same prose here"] * 4)
    pdf = "It was a long line of prose that fills the measure of the\npage and ends.\nThen another long line of prose begins and fills the page\nagain to its end"
    rows = [(1, indented, False, "x"), (2, pdf, True, "x"), (3, pdf, None, "x"), (4, broken, False, "x"), (5, None, False, "x"), (6, "", True, "x"), (7, "CHAPTER\n\nIV\n\nProse.", False, "x")]
    got = {r.doc: r for r in dr.repair_texts(spark.createDataFrame(rows, TEXTS)).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    assert got[1].ligatures == 1 and got[1].page_marks == 1 and got[1].healed == 1 and got[1].indented == 2
    assert got[1].text.startswith("   The first paragraph\ngoes on") and "\n\n   Second one says   things\nand closes at last.\n\n   Third." in got[1].text
    assert got[2].restored == 1 and "page and ends.\n\nThen another" in got[2].text and got[3].text == pdf
    assert got[4].line_blocks == 24 and "\n\n" not in got[4].text and got[6].text == ""
    assert got[7].headings == 1 and got[7].text.startswith("CHAPTER IV")
    assert dr.repair_texts(spark.createDataFrame([], TEXTS)).count() == 0


BOOK = "book bigint, ch_idx int, num int, p_idx bigint, text string, extra string"


def chapters(book, texts, num):
    return [(book, c, num(c), p, t, None) for c, ps in enumerate(texts) for p, t in enumerate(ps)]


def test_a_reader_is_built_by_the_branch_its_editions_allow(spark):
    fr = [[f"Bonjour Marvel{c}x numéro {p}, dit {'BCD'[c]}{'aeiou'[p]}rtolin." for p in range(5)] for c in range(3)]
    en = [[f"Hello Marvel{c}x number {p}, said {'BCD'[c]}{'aeiou'[p]}rtolin." for p in range(5)] for c in range(3)]
    left = [r for b, num in ((1, lambda c: c + 1), (2, lambda c: None), (3, lambda c: None)) for r in chapters(b, fr, num)]
    right = [*chapters(1, en, lambda c: c + 1), *chapters(2, en, lambda c: None), *chapters(3, [["Nothing in common at all with the other."]], lambda c: None)]
    huge = [(9, 0, None, 0, "a" * 9000, None), (9, 0, None, 1, None, None)]
    pairs, refused = dr.build_reader(spark.createDataFrame([*left, *huge], BOOK), lambda text, before, value: text.upper(), spark.createDataFrame(right, BOOK))
    rows = pairs.orderBy("book", "pos").collect()
    assert {r.book for r in refused.collect()} == {9} and len(rows) == 45
    assert {(r.book, r.method) for r in rows} == {(1, "numbered"), (2, "anchored"), (3, "proportional")}
    flat = [t for ps in en for t in ps]
    assert [r.published for r in rows if r.book == 1] == flat and [r.published for r in rows if r.book == 2] == flat
    assert all(r.translation == r.text.upper() for r in rows)
    alone, _ = dr.build_reader(spark.createDataFrame(left, BOOK), lambda text, before, value: before[:3] + text)
    assert {r.published for r in alone.collect()} == {""}


def test_vectors_are_asked_once_a_content_and_wrong_lengths_left_out(spark):
    asked = spark.sparkContext.accumulator(0)

    def embed(batch):
        asked.add(len(batch))
        return [[1.0] if t == "bad" else [float(len(t)), 2.0] for t in batch]

    rows = [(1, "one"), (2, " one "), (3, "three"), (4, None), (5, "bad"), (6, "")]
    texts, cache = spark.createDataFrame(rows, "id bigint, text string"), spark.createDataFrame([], "key string, value string")
    vectors, fresh = dr.embed_cached(texts, embed, cache)
    assert {(r.id, *r.vector) for r in vectors.collect()} == {(1, 3.0, 2.0), (2, 3.0, 2.0), (3, 5.0, 2.0), (6, 1.0, 2.0)} and asked.value == 4
    again, more = dr.embed_cached(texts, embed, fresh)
    assert again.count() == 4 and more.count() == 0 and asked.value == 4
