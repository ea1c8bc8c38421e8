"""Sentence alignment and scanned pages on made books with known answers."""

import itertools
import random
import re
from types import SimpleNamespace

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import p4_bitext as p4
from lectern.llm import p5_scan as p5

WORDS = random.Random(9)
FR = sorted({"".join(WORDS.choice(x) for x in ("bcdfgl", "aeiou", "mnprst", "aeiou", "xz")) for _ in range(200)})
EN = [w[::-1] + "th" for w in FR]
SENT = "sent_id bigint, chapter_id bigint, p_idx int, s_idx int, lang string, text string"
CHAP = "chapter_id bigint, edition_id bigint, ch_idx int, number_token string, part_no int"


def bilingual(seed=1, chapters=40):
    rng = random.Random(seed)
    rows, want, sid = [], set(), 0
    for c in range(chapters):
        clauses = [[rng.randrange(len(FR)) for _ in range(5)] + [f"Nom{rng.randrange(400)}x"] for _ in range(8)]
        say = lambda words, lex: " ".join(lex[w] if isinstance(w, int) else w for w in words)
        left, right, k = [], [], 0
        while k < len(clauses):
            kind = rng.random()
            if kind < 0.15 and k + 1 < len(clauses):
                left.append((say(clauses[k], FR) + " ; " + say(clauses[k + 1], FR) + ".", {k, k + 1}))
                right.extend((say(clauses[j], EN) + ".", {j}) for j in (k, k + 1))
                k += 2
                continue
            if kind < 0.9:
                left.append((say(clauses[k], FR) + ".", {k}))
            if kind > 0.2:
                right.append((say(clauses[k], EN) + ".", {k}))
            k += 1
        if len(right) > 3:
            right[1], right[2] = right[2], right[1]
        ids = []
        for side, (lang, ss) in enumerate((("fr", left), ("en", right))):
            for j, (text, held) in enumerate(ss):
                rows.append((sid, 2 * c + side, j, 0, lang, text))
                ids.append((sid, lang, held))
                sid += 1
        want |= {(min(a, b), max(a, b)) for (a, x, p), (b, y, q) in itertools.combinations(ids, 2) if x != y and p & q}
    chap = [(2 * c + s, s + 10, c, str(c + 1) if s else f"Chapitre {c + 1}", None) for c in range(chapters) for s in (0, 1)]
    return rows, chap, want


def test_alignment_finds_merges_and_reordering(spark):
    rows, chap, want = bilingual()
    s, c = spark.createDataFrame(rows, SENT), spark.createDataFrame(chap, CHAP)
    r = spark.createDataFrame([(10, 11), (10, 11), (None, 11)], "fr_edition_id bigint, en_edition_id bigint")
    g = spark.createDataFrame([(FR[0], EN[0]), (None, "x")], "term_fr string, term_en string")
    got = {(min(x.f, x.e), max(x.f, x.e)) for x in p4.align_sentences(s.repartition(5), c, r, g).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)
    empty = p4.align_sentences(s.filter("false"), c, r, g)
    assert empty.count() == 0


def test_chapters_pair_by_part_or_by_order(spark):
    chap = [(0, 1, 0, "I", 1), (1, 1, 1, "I", 2), (2, 2, 0, "1", None), (3, 2, 1, "2", None), (4, 2, 2, None, None), (5, 3, 0, "One", 1), (6, 3, 1, "One", 2)]
    r = spark.createDataFrame([(1, 2), (1, 3)], "fr_edition_id bigint, en_edition_id bigint")
    got = {(x.fr_chapter, x.en_chapter) for x in p4.paired_chapters(r, spark.createDataFrame(chap, CHAP)).collect()}
    assert got == {(0, 2), (1, 3), (0, 5), (1, 6)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_finds_every_word_within_two_edits():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))): 1 for _ in range(400)}
    trie = p5.Trie(words)
    for _ in range(120):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
        assert sorted(trie.within(w)) == sorted(v for v in words if edits(w, v) <= 2)
    assert p5.Trie({}).within("a") == [] and trie.within("") == [] and trie.within("a" * 99) == []


def test_verdicts_without_any_list():
    trie = p5.Trie({"window": 9, "couloir": 9, "cette": 9, "chapeau": 9, "premier": 5, "maison": 9, "the": 90, "lost": 9, "word": 9, "ville": 9})
    assert p5.correct("winclow", trie) == ("misread", ["window"]) and p5.correct("coul0ir", trie)[0] == "misread"
    assert p5.correct("thelost", trie) == ("joined", ["the lost"]) and p5.correct("cettechapeau", trie)[0] == "joined"
    assert p5.correct("zebra", trie) == (None, []) and p5.correct("1er", trie) == (None, []) and p5.correct("maiſ", trie)[0] == "misread"
    for read, right in (("vvord", "word"), ("tne", "the"), ("maifon", "maison"), ("yille", "ville"), ("vlle", "ville"), ("villle", "ville"), ("rnaison", "maison")):
        kind, repairs = p5.correct(read, trie)
        assert kind == "misread" and repairs[0] == right, (read, repairs)


def test_what_is_often_seen_costs_less_and_a_rare_word_may_stand():
    counts = [("maison", 4000), ("moisson", 400), ("nuage", 3000), ("le", 90_000)]
    costs = p5.learned(counts, ops={("a", "o"): 60.0, ("m", "rn"): 30.0}, new=2.0)
    assert costs.ops["a", "o"] < costs.unseen("a") and p5.difference("maison", "rnaison") == ("m", "rn") and p5.difference("ville", "villle") == ("", "l")
    trie = p5.Trie(dict(counts))
    assert p5.correct("moison", trie, costs)[1][0] == "maison"
    once = lambda n: p5.candidates(["moison"], [n], [float("nan")], trie, costs)
    assert [c[3] for c in once(0)] == ["maison"] and once(300) == []


def test_a_page_taken_apart():
    paras = ["Le chat noir vit la mai-\nson rouge et la", "LA LUNE ET LE PONT — NOMVELFI  12", "porte ouverte. Une porte-\nplume tomba", "- 13 -", "Au loin.", None, ""]
    page = p5.Page(paras, [p5._title_key("La_lune_et_le_pont")], set())
    assert page.kinds == {(1, "header"), (2, "cont"), (3, "pageno"), (4, "cont")}
    words = list(page.words())
    assert (0, "maison", "mai-son", "-") in words and (2, "porteplume", "porte-plume", "-") in words
    assert not p5.is_header("TOUS DROITS RÉSERVÉS À LANTERNE", [p5._title_key("La lune et le pont")])
    assert p5.is_header("LF PONT  7", [p5._title_key("Le pont")]) and p5.is_header("8  LA LUNE ET LF P0NT — X", [p5._title_key("La lune et le pont")])
    assert p5.Page([], [], set()).kinds == set()


def test_a_page_rebuilt():
    paras = ["Le chot noir vit la mai-\nson rouge et la", "LA LUNE ET LE PONT  12", "porte ouverte. Une porte-\nplume tomba surla\n13\nroute fin¬", "", "14", "ale. Non"]
    page = p5.Page(paras, [p5._title_key("La lune et le pont")], set())
    repairs = {(0, "chot"): "chat", (2, "surla"): "sur la"}
    assert p5.rebuild(page, repairs, {"porte-plume"}) == ["Le chat noir vit la maison rouge et la porte ouverte. Une porte-plume tomba sur la route finale. Non"]
    assert p5.rebuild(p5.Page([], [], set()), {}, set()) == []


def test_scanned_books_end_to_end(spark):
    rng = random.Random(6)
    words = [w for w in FR if len(w) > 4]
    clean = [(k, 1, None, [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(20)]) for k in range(10)]
    bad = words[0][:2].replace("e", "c") + words[0][2:]
    noisy = [f"{words[3]} {words[1][:3]}-\n{words[1][3:]} {words[2]}{words[5]} {words[4]}", "UN TITRE  4", f"{words[6]} {words[7]}.\n{words[8]}."]
    chap = "chapter_id bigint, edition_id bigint, title string, paragraphs array<string>"
    c = spark.createDataFrame([*clean, (99, 2, "Un titre", noisy), (100, 3, None, None), (101, None, "x", ["a\nb"])], chap)
    e = spark.createDataFrame([(1, "s", "P"), (2, "s", "Autre")], "edition_id bigint, source string, page string")
    b = spark.createDataFrame([(1, None), (2, "f.pdf")], "edition_id bigint, title string")
    got = {(r.chapter_id, r.p_idx, r.kind) for r in p5.ScanNoise(c, e, b).found().collect()}
    assert got == {(99, 0, "hyphen"), (99, 0, "joined"), (99, 1, "header"), (99, 2, "cont")}, bad
    assert p5.ScanNoise(c.filter("false"), e, b).found().count() == 0


def test_a_vocabulary_in_blocks_gives_the_verdicts_of_one(spark, monkeypatch):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("eaoinlcmrtu") for _ in range(rng.randrange(3, 8))) for _ in range(300)})
    vocabulary = spark.createDataFrame([(w, rng.randrange(2, 40)) for w in words], "word string, n bigint")
    known = set(words)
    bad = {rng.choice(words) + rng.choice(words) for _ in range(40)} | {w.replace("m", "rn").replace("e", "c", 1) for w in words} | {"c0", "1er", "a|e", "x0yz", "y" * 90}
    unknown = spark.createDataFrame([(w,) for w in sorted(bad - known)], "word string")
    result = lambda: {r.word: (r.kind, [(x.text, round(x.cost, 6), round(x.p, 6)) for x in r.repairs]) for r in p5.word_types(unknown, vocabulary).collect()}
    want = result()
    monkeypatch.setattr(p5, "VOCABULARY_BLOCK", 60)
    monkeypatch.setattr(p5, "TYPES_BLOCK", 90)
    assert result() == want and {"misread", "joined"} == {k for k, _ in want.values()}


def least_cost(right, read, costs, steps):
    """The least cost of turning ``right`` into ``read`` in so many steps, by brute force over both texts."""
    best = {(0, 0, 0): 0.0}
    for i in range(len(right) + 1):
        for j in range(len(read) + 1):
            for s in range(steps + 1):
                now = best.get((i, j, s))
                if now is None:
                    continue
                if i < len(right) and j < len(read) and right[i] == read[j]:
                    best[i + 1, j + 1, s] = min(now, best.get((i + 1, j + 1, s), 1e9))
                for a, b in ((1, 0), (0, 1), (1, 1), (1, 2), (2, 1)):
                    if s < steps and i + a <= len(right) and j + b <= len(read):
                        x, y = right[i : i + a], read[j : j + b]
                        cost = min(costs.unseen(x[:1]), costs.ops.get((x, y), 1e9))
                        best[i + a, j + b, s + 1] = min(now + cost, best.get((i + a, j + b, s + 1), 1e9))
    return min(best.get((len(right), len(read), s), 1e9) for s in range(steps + 1))


def test_every_word_within_the_budget_is_retrieved_at_its_least_cost():
    rng = random.Random(12)
    words = {"".join(rng.choice("eaoinlcmrtudhé") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 99) for _ in range(300)} | {"m" * 70: 5}
    trie = p5.Trie(words)
    costs = p5.learned(words.items(), ops={("m", "rn"): 40.0, ("cl", "d"): 9.0, ("e", "c"): 80.0, ("", "l"): 3.0, ("n", ""): 2.0})
    asked = [("".join(rng.choice([c, c, c, "x", "rn", ""]) for c in rng.choice(sorted(words))), rng.choice([4.0, 9.0, 12.0, 16.0])) for _ in range(60)] + [("m" * 69 + "rn", 9.0)]
    w, v, c = trie.search([a for a, _ in asked], costs, [b for _, b in asked])
    got = {(k, trie.words[x]): y for k, x, y in zip(w.tolist(), v.tolist(), c.tolist())}
    want = {(k, r): least_cost(r, a, costs, 2) for k, (a, b) in enumerate(asked) for r in words if a}
    want = {k: y for k, y in want.items() if y <= asked[k[0]][1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 60 and (60, "m" * 70) in got
    assert len(p5.Trie({}).search(["a"], costs, [9.0])[0]) == 0 and len(trie.search(["", "a"], costs, [0.0, -1.0])[0]) == 0


def test_the_word_before_may_choose_a_word_of_more_misreadings(spark):
    vocabulary = spark.createDataFrame([("lone", 9), ("lane", 5), ("petite", 9)], "word string, n bigint")
    suspects = spark.createDataFrame([(1, 0, "lonc", "petite", None), (1, 1, "lonc", "une", None), (1, 2, "lonc", None, None)], "chapter_id bigint, p_idx bigint, part string, before string, after string")
    clean = spark.createDataFrame([(["la petite lane", "Petite lane."],)], "paragraphs array<string>")
    types = p5.word_types(suspects.select(F.col("part").alias("word")).distinct(), vocabulary)
    got = {r.before: r.repair for r in p5.choices(SimpleNamespace(suspects=suspects, types=types, clean=clean)).collect()}
    assert got == {"petite": "lane", "une": "lone", None: "lone"}


def test_a_passage_moved_across_a_long_chapter_is_found(spark):
    rng = random.Random(13)
    clauses = [[rng.randrange(len(FR)) for _ in range(6)] for _ in range(1800)]
    order = [*range(1740, 1800), *range(1740)]
    rows = [(k, 0, k, 0, "fr", " ".join(FR[w] for w in c) + f" Nom{k}x.") for k, c in enumerate(clauses)]
    rows += [(10_000 + k, 1, j, 0, "en", " ".join(EN[w] for w in clauses[k]) + f" Nom{k}x.") for j, k in enumerate(order)]
    s = spark.createDataFrame(rows, SENT)
    c = spark.createDataFrame([(0, 10, 0, "1", None), (1, 11, 0, "1", None)], CHAP)
    r = spark.createDataFrame([(10, 11)], "fr_edition_id bigint, en_edition_id bigint")
    g = spark.createDataFrame([(None, "x")], "term_fr string, term_en string")
    got = {(x.f, x.e) for x in p4.align_sentences(s, c, r, g).collect()}
    assert sum((k, 10_000 + k) in got for k in order[:60]) >= 57 and sum((k, 10_000 + k) in got for k in order[60:]) >= 1650


ODD_LINES = st.text(alphabet="aéZ9 _|-‐¬\u00ad.,—\u00a0\t\u0345Ⓐⓐ", max_size=30)


@settings(max_examples=500, deadline=None)
@given(ODD_LINES)
def test_shortcuts_on_lines_change_no_result(line):
    span = lambda m: m and m.regs
    assert span(p5.ends_split(line)) == span(p5.ENDS_SPLIT.search(line))
    plain = re.compile(r"(?:[^\W_]|\|)+(?:-(?:[^\W_]|\|)+)*")
    assert p5.TOKEN.findall(line) == plain.findall(line) and span(p5.TOKEN.match(line)) == span(plain.match(line))
    body = re.sub(r"^\W*\d{0,4}\s+(?=\S)|\s+\d{1,4}\W*$", "", line.strip())
    assert not p5.SMALL.search(line) or body != body.upper()


def test_only_lines_that_end_in_a_hyphen_are_looked_through(monkeypatch):
    looked, pattern = [], p5.ENDS_SPLIT
    monkeypatch.setattr(p5, "ENDS_SPLIT", SimpleNamespace(search=lambda line: looked.append(line) or pattern.search(line)))
    page = p5.Page(["Une ligne qui conti-\nnue ici sans trait\net une autre."], [], set())
    assert [w for _, w, _, _ in page.words()] == "Une ligne qui continue ici sans trait et une autre".split()
    assert looked == ["Une ligne qui conti-"]


def test_site_lines_are_placed_in_scanned_books_only(spark, monkeypatch):
    seen, lines = [], p5.chapter_lines
    monkeypatch.setattr(p5, "chapter_lines", lambda rows: seen.append(rows) or lines(rows))
    long = "Texte propose par le site des livres anciens"
    rows = [(k, k % 2, "t", [f"{long}\nun paragraphe assez long sur {FR[k]} {FR[k + 1]} {FR[k + 2]}"]) for k in range(2 * p5.MIN_CHAPTERS + 4)]
    c = spark.createDataFrame(rows, "chapter_id bigint, edition_id bigint, title string, paragraphs array<string>")
    e = spark.createDataFrame([(0, "site", "p"), (1, "site", "p")], "edition_id bigint, source string, page string")
    b = spark.createDataFrame([(0, "Livre"), (1, "Livre")], "edition_id bigint, title string")
    scans = spark.createDataFrame([(1, 10)], "edition_id bigint, chars bigint")
    got = p5.scan_pages(c, e, b, scans).collect()
    assert {r.chapter_id for r in got} == {k for k, edition, *_ in rows if edition == 1}
    assert all([(x.p, x.l) for x in r.site] == [(0, 0)] for r in got)
    assert [{r.edition_id for r in s.collect()} for s in seen] == [{0, 1}, {1}]
