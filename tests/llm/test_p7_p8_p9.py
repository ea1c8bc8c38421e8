"""Containers, leaks and pieces against exhaustive answers and exact round trips."""

import itertools
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import p7_packing as p7
from lectern.llm import p8_leak as p8
from lectern.llm import p9_split as p9
from lectern.llm.tokens import token_count, token_starts

DOCS = "doc_id bigint, text string, bin_id string, n_tokens string"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 25), st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4))
def test_the_best_fill_is_the_best(room, counts):
    lengths = sorted(counts, reverse=True)
    best = max(s for picks in itertools.product(*[range(counts[n] + 1) for n in lengths]) if (s := sum(n * k for n, k in zip(lengths, picks))) <= room)
    used = p7.best_fill(room, lengths, [counts[n] for n in lengths])
    assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_a_plan_uses_every_item_once():
    rng = random.Random(1)
    histogram = Counter(rng.randrange(1, 101) for _ in range(5000))
    used, bins = Counter(), 0
    for fill, times in p7.plan(histogram, 100):
        assert sum(n * k for n, k in fill.items()) <= 100
        bins += times
        used.update({n: k * times for n, k in fill.items()})
    total = sum(n * k for n, k in histogram.items())
    assert used == histogram and bins <= -(-total // 100) * 1.01 + 1
    assert p7.plan({}, 10) == []


def test_packing_is_whole_within_capacity_and_splits_only_the_oversized(spark):
    rng = random.Random(2)
    texts = ["word " * rng.randrange(1, 120) for _ in range(200)] + ["same text here"] * 150 + ["mot " * 900, "", None]
    df = spark.createDataFrame([(k // 2, t, "x", "y") for k, t in enumerate(texts)], DOCS)
    rows = p7.pack(df, 128).collect()
    fill = Counter()
    for r in rows:
        if r.bin_id is not None:
            fill[r.bin_id] += r.n_tokens
    assert max(fill.values()) <= 128 and sum(r.bin_id is None for r in rows) == 2
    assert sorted(fill) == list(range(len(fill)))
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(k // 2 for k in range(len(texts)))
    assert {r.doc_id for r in rows if r.piece > 0} == {350 // 2}
    assert sum(fill.values()) / (128 * len(fill)) > 0.97
    assert p7.pack(df.filter("false"), 128).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.\n,—!😀x", min_size=0, max_size=600), st.integers(8, 40))
def test_pieces_rebuild_the_text_and_keep_the_limit(text, limit):
    parts = p9.split_text(text, limit, limit // 4)
    assert "".join(text[b:e] for _, b, e, _ in parts) == text
    for k, (s, b, e, n) in enumerate(parts):
        assert n <= limit and n == token_count(text[s:e]) and s <= b <= e
        assert k == 0 or (token_count(text[s:b]) <= limit // 4 and s >= parts[k - 1][1])


def test_cuts_stand_at_the_strongest_boundaries():
    text = "\n\n".join("Une phrase assez longue pour compter ici. Une autre phrase vient." for _ in range(60))
    parts = p9.split_text(text, 256, 16)
    assert len(parts) > 2 and all(text[:b].endswith("\n\n") for _, b, _, _ in parts[1:])
    at, strength = p9.boundaries(" a. b\n\nc, d\n# e\nf")
    assert dict(zip(at.tolist(), strength.tolist()))[7] == 5 and 6 in strength and 2 in strength and 3 in strength
    endless = p9.split_text("x" * 20_000, 128, 8)
    assert "".join("x" * (e - b) for _, b, e, _ in endless) == "x" * 20_000


def test_token_starts():
    text = "L'été 😀 noir"
    assert len(token_starts(text)) == token_count(text) and token_starts("").size == 0
    assert list(token_starts(text)) == sorted(token_starts(text))


def test_split_documents_handles_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, "short", "", ""), (4, "word " * 700, "", ""), (4, "word " * 700, "", "")], DOCS)
    rows = p9.split_documents(df, 256, 16).collect()
    assert {r.doc_id for r in rows} == {4} and len(rows) == 2 * rows[0].pieces


def prose(rng, n, tag=""):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}{tag}" for _ in range(n))


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = stored[:200].copy()
    for _ in range(p8.RADIUS):
        near ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    asked = np.concatenate([near, rng.integers(0, 2**63, 300, dtype=np.uint64)])
    at, found = p8.HammingIndex(stored).search(asked)
    want = {(i, j) for i in range(len(asked)) for j in range(len(stored)) if bin(int(asked[i]) ^ int(stored[j])).count("1") <= p8.RADIUS}
    assert set(zip(at.tolist(), found.tolist())) == want and len(want) >= 200 and len(at) == len(want)
    assert len(p8.HammingIndex(stored[:0]).search(asked)[0]) == 0


def test_leaks_whole_partial_and_disguised(spark):
    rng = random.Random(5)
    passages = [prose(rng, 80) for _ in range(8)]
    lead, tail = "Read the passage below.", "Who did this?"
    items = [(k, "x", f"{lead} {p[0].upper()}{p[1:]}. {tail}" if k % 2 else p) for k, p in enumerate(passages)] + [(100, "x", passages[0])]
    items = [(i, x, t) for i, x, t in items]
    w = [p.split() for p in passages]
    docs = [
        (0, prose(rng, 50) + " " + passages[0] + " " + prose(rng, 50)),
        (1, prose(rng, 40) + " " + " ".join(w[1][20:50]) + " " + prose(rng, 40)),
        (2, prose(rng, 40) + " " + " ".join(w[2][:20]) + " " + prose(rng, 200)),
        (3, " ".join(x if k % 17 else "AUTRE" for k, x in enumerate(w[3])).upper().replace(" ", ",\n")),
        (4, " ".join(f"<b>{x}</b>" if k % 5 == 0 else x for k, x in enumerate(w[4]))),
        (5, " ".join(w[5]).replace("a", "а").replace("o", "ο")),
        (6, f"{lead} {prose(rng, 100)} {tail}"),
        (7, None), (8, ""), (0, prose(rng, 10)),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    e = spark.createDataFrame(items, "item_id bigint, doc_id string, text string")
    assert {tuple(r) for r in p8.find_leaks(d, e).collect()} == {(0, 0), (0, 100), (1, 1), (3, 3), (4, 4), (5, 5)}
    assert p8.find_leaks(d, e.filter("false")).count() == 0 and p8.find_leaks(d.filter("false"), e).count() == 0


def test_instructions_are_told_by_all_items_whatever_the_block(spark):
    items = [(k, "z", f"Read this now. {t} body text. Where is it?") for k, t in enumerate(("Alpha", "Beta", "Gamma", "Delta"))]
    rows = [*items, (9, "z", "One only. Two only."), (10, "z", None), (None, "z", "Nobody's."), (11, "z", ""), items[0]]
    e = spark.createDataFrame(rows, "item_id bigint, keys string, text string")
    passages = {r.item_id: r.text for r in p8.own_passages(e).collect()}
    assert passages == {0: "Alpha body text.", 1: "Beta body text.", 2: "Gamma body text.", 3: "Delta body text.", 9: "One only. Two only.", 11: ""}
    rng = random.Random(12)
    texts = [prose(rng, 50) for _ in range(12)]
    e = spark.createDataFrame([(k, f"Read this now. {t}.") for k, t in enumerate(texts)], "item_id bigint, text string")
    d = spark.createDataFrame([(k, f"Read this now. {prose(rng, 20)} {t} {prose(rng, 20)}") for k, t in enumerate(texts[::2])], "doc_id bigint, text string")
    whole = {tuple(r) for r in p8.find_leaks(d, e).collect()}
    assert whole == {(k, 2 * k) for k in range(6)} and whole == {tuple(r) for r in p8.find_leaks(d, e, block=120).collect()}


def disturbed(rng, words, every):
    return [w if (k + 1) % every else f"autre{rng.randrange(999)}" for k, w in enumerate(words)]


def test_recall_by_replaced_words():
    """Thirds and wholes with every n-th word replaced: what the verifier accepts is found, nine of ten at every sixth."""
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(40, 150)).split()) for k in range(150)]
    index = p8.LeakIndex(items)
    fill = lambda: prose(rng, rng.randrange(20, 60), "q").split()
    for every, least in ((20, 0.99), (12, 0.97), (9, 0.95), (6, 0.9)):
        for share in (3, 1):
            found = accepted = 0
            for k, words in items:
                n = -(-len(words) // share)
                low, lead = rng.randrange(len(words) - n + 1), fill()
                doc = [*lead, *disturbed(rng, words[low : low + n], every), *fill()]
                if p8.holds_piece(doc, words, len(lead) - low):
                    accepted += 1
                    found += (0, k) in set(index.search([doc]))
            assert accepted > 130 and found >= least * accepted, (every, share, found, accepted)


def test_search_is_within_the_verifier_and_finds_pieces_of_small_items():
    rng = random.Random(9)
    items = [(k, prose(rng, n).split()) for k, n in enumerate((2, 5, 9, 20, 33, 47))] + [(7, ["un"]), (8, [])]
    index = p8.LeakIndex(items)
    docs = [[*prose(rng, 15, "q").split(), *w[len(w) // 4 :], *prose(rng, 9, "q").split()] for _, w in items[:6]]
    got = set(index.search(docs))
    assert got == {(k, k) for k in range(6)}
    shifts = lambda d, w: {i - j for i in range(len(d) - 1) for j in range(len(w) - 1) if d[i : i + 2] == w[j : j + 2]}
    assert all(any(p8.holds_piece(docs[d], items[i][1], s) for s in shifts(docs[d], items[i][1])) for d, i in got)
    assert list(index.search([])) == list(index.search([["un"], []])) == [] and list(p8.LeakIndex([]).search(docs)) == []


def test_running_sums_are_packed_and_give_the_majority_of_every_window():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 700, dtype=np.uint64)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    for size, step in ((2, 1), (9, 3), (28, 9), (255, 1), (256, 85), (300, 7)):
        want = [np.packbits(bits[i : i + size].sum(axis=0) > 0).view(np.uint64)[0] for i in range(0, len(hashes) - size + 1, step)]
        assert p8.fingerprints(p8.word_sums(hashes, size), size, step).tolist() == want
        assert p8.fingerprints(p8.word_sums(hashes), size, step).tolist() == want
    assert p8.word_sums(hashes, 28).nbytes <= 64 * (len(hashes) + 1)
    assert p8.word_sums(hashes[:0], 28).shape[0] == 1 and len(p8.fingerprints(p8.word_sums(hashes[:5], 9), 9)) == 0


def test_scattered_pairs_do_not_reach_the_verifier(monkeypatch):
    rng = random.Random(14)
    item = [f"w{k}" for k in range(100)]
    doc = [x for k in range(0, 98, 5) for x in (*item[k : k + 2], *(f"z{rng.randrange(9999)}" for _ in range(3)))]
    index, calls = p8.LeakIndex([(1, item)]), []
    monkeypatch.setattr(p8, "holds_piece", lambda *a: calls.append(a) or False)
    assert not index._holds(doc, 0, 0) and not calls
    assert not index._holds(item, 0, 0) and len(calls) == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=40), st.lists(st.sampled_from("abcdefghxyz"), max_size=60), st.integers(-10, 30))
def test_the_density_refuses_nothing_the_verifier_accepts(item, other, shift):
    for doc in (other, [*other[:10], *item[len(item) // 3 :], *other[10:]]):
        margin = p8.margin_of(len(item))
        part = doc[max(0, shift - margin) : shift + len(item) + margin]
        if p8.holds_piece(doc, item, shift):
            assert p8.dense_enough(item, set(zip(part, part[1:])) & set(zip(item, item[1:])))
            assert p8.LeakIndex([(0, item)])._holds(doc, 0, shift)
