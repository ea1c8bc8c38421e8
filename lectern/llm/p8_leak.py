"""Evaluation texts leaking into training text.

Method: windows are sized by the item: three quarters of the least piece that counts, so that
every such piece holds a whole window of the document, of which one starts every third of a
window. Each window gets the SimHash of its words; a multi-index over the blocks of the
fingerprint finds all stored windows of that size within the radius for certain. Windows that
stand near each other in documents and items are verified exactly: the longest piece the two
texts share in order, by weighted (counted) word-pair shingles.

The radius is measured on replaced words (``tests/llm``, README): it finds at least nine of ten
thirds of a passage with every sixth word replaced. The items are the stated query set; they are
processed in blocks of ``BLOCK`` words, so what is broadcast is bounded, and every document
is read whole. Instructions and questions are told by all items, not by one block's.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.p3_lookalike import skeletons
from lectern.session import table, written

#: Words of passages whose windows are indexed and broadcast at once (each window takes some 2 kB).
BLOCK = 100_000
#: Every fingerprint within the radius agrees with the stored one, but for at most two bits, in one of the blocks.
RADIUS, BLOCKS = 11, 4
#: A window is this share of the least piece; the windows of a document start a third of a window apart.
WINDOW_SHARE, STARTS = 0.75, 3
#: The share of a window's words that stand at the same place in both texts; added and left out words shift the rest.
ALIGNED, DRIFT = 0.25, 2
#: TESTDATA.md: a third of the passage in one piece; a word is allowed to be missing at either end.
SHARE, SIMILAR, GAP, SLIP = 0.3, 0.6, 8, 6
CHUNK_WORDS = 50_000
#: Windows are looked up so many at a time that about this many stored ones are compared at once.
COMPARED = 400_000

WORD = re.compile(r"[^\W_]+")
COMMON = re.compile(r"[\x00-\x7f\xa0-\xac\xae-ſ‐-‧‰-⁞]*\Z")
SIGNS = re.compile(r"[<&\\{\[]")
MARKUP = re.compile(r"<ref\b[^<>]*>[^<]*(?:<(?!/?ref\b)[^<]*)*</ref>|</?[A-Za-z!][^<>]*>|\\[A-Za-z]+\*?|\{\{[^{}|]*\||\[\[[^\[\]|]*\||\]\([^()\s]*\)|\[\^?\d{1,3}\]|\[\^[^\[\]\s]+\]", re.I)


def words_of(texts: list[str]) -> list[list[str]]:
    """The words of each text: look-alikes in one form, markup taken out, case and signs ignored."""
    special = [k for k, t in enumerate(texts) if not COMMON.match(t)]
    if special:
        texts = list(texts)
        for k, s in zip(special, skeletons([texts[k] for k in special])):
            texts[k] = s
    out = []
    for t in texts:
        if SIGNS.search(t):
            t = MARKUP.sub("", html.unescape(t) if "&" in t else t)
        out.append(WORD.findall(t.lower()))
    return out


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > 2_000_000:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def word_sums(hashes: np.ndarray, longest: int = 65_535) -> np.ndarray:
    """Running sums of the words' hash bits, as many in a number as windows of up to ``longest`` words allow.

    Numbers wrap around and carry into each other's places, but the difference of two rows is exact
    where no bit is counted more than ``longest`` times between them.
    """
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    place = np.min_scalar_type(longest)
    bits = np.unpackbits(mixed.view(np.uint8)).astype(place, copy=False).view(np.uint64).reshape(-1, 8 * place.itemsize)
    sums = np.zeros((bits.shape[1], len(hashes) + 1), dtype=np.uint64)
    np.cumsum(bits.T, axis=1, out=sums[:, 1:])
    return np.ascontiguousarray(sums.T)


def fingerprints(sums: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """SimHash of the windows of ``size`` words, one every ``step`` words: one bit for a majority of the words."""
    if len(sums) <= size:
        return np.empty(0, np.uint64)
    ones = (sums[size::step] - sums[: len(sums) - size : step]).view(f"u{sums.shape[1] // 8}")
    return np.packbits(ones > size // 2).view(np.uint64)


class HammingIndex:
    """All stored fingerprints within ``RADIUS`` bits, through near equality of one of the blocks.

    Of ``BLOCKS`` blocks one differs in at most RADIUS // BLOCKS bits; every stored fingerprint
    stands under each key of a block that is so near to its own.
    """

    EDGES = [round(64 * b / BLOCKS) for b in range(BLOCKS + 1)]
    MASKS = {w: np.array([sum(1 << x for x in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(w), r)]) for w in {64 // BLOCKS, -(-64 // BLOCKS)}}

    def __init__(self, prints: np.ndarray):
        self.prints, self.order, self.start = prints, [], []
        for low, high in zip(self.EDGES, self.EDGES[1:]):
            own = self._block(prints, low, high)
            near = self.MASKS[high - low]
            key = (own[:, None] ^ near[None]).ravel()
            self.order.append((np.argsort(key.astype(np.uint16), kind="stable") // len(near)).astype(np.min_scalar_type(len(prints))))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << (high - low)))]).astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, stored) of every pair within the radius, each once."""
        ats, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, int(COMPARED / max(1.0, len(self.prints) * 0.003)))
        for first in range(0, len(prints), step):
            asked = prints[first : first + step]
            for b, (low, high) in enumerate(zip(self.EDGES, self.EDGES[1:])):
                key = self._block(asked, low, high)
                begin = self.start[b].take(key)
                n = self.start[b].take(key + 1) - begin
                until = np.cumsum(n)
                where = np.repeat(begin - until + n, n)
                where += np.arange(len(where))
                stored = self.order[b].take(where)
                differ = self.prints.take(stored)
                differ ^= np.repeat(asked, n)
                near = np.flatnonzero(np.bitwise_count(differ) <= RADIUS)
                ats.append(np.searchsorted(until, near, "right") + first)
                found.append(stored[near].astype(np.int64))
        both = np.unique(np.concatenate(ats) * np.int64(max(1, len(self.prints))) + np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


SENTENCE = re.compile(r"(?<=[.?!…])\s+|\n+")
PARTS = "item_id bigint, parts array<string>, keys array<string>"


def own_passages(items: DataFrame) -> DataFrame:
    """(item_id, text): the items without instruction or question, told by all items.

    A first (last) sentence is an instruction (a question) where it stands first (last) in at
    least three items and is followed (preceded) by at least three different sentences; up to
    three of them are taken off. NULL ids and texts give no row; a repeated row gives one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[s for s in SENTENCE.split(t) if WORD.search(s)] for t in batch["text"]]
            keys = [[" ".join(WORD.findall(s.lower())) for s in p] for p in parts]
            yield pd.DataFrame({"item_id": batch["item_id"], "parts": parts, "keys": keys})

    rows = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct().mapInPandas(cut, PARTS)
    rows = written(rows, "items")
    for _ in range(3):
        many = rows.filter(F.size("keys") > 1)
        for side, first, second in (("lead", 1, 2), ("tail", -1, -2)):
            own, beside = F.element_at("keys", first).alias(side), F.element_at("keys", second).alias("beside")
            fixed = many.select(own, beside).groupBy(side).agg(F.count("*").alias("n"), F.count_distinct("beside").alias("m")).filter("n >= 3 and m >= 3")
            rows = rows.withColumn(side, F.when(F.size("keys") > 1, F.element_at("keys", first))).join(fixed.select(side, F.lit(1).alias(f"{side}_off")), side, "left").na.fill(0, [f"{side}_off"])
        kept = F.size("keys") - F.col("lead_off") - F.col("tail_off")
        take = lambda c: F.when(kept > 0, F.slice(c, F.col("lead_off") + 1, kept)).otherwise(F.col(c)).alias(c)
        rows = written(rows.select("item_id", take("parts"), take("keys")), "items")
    return rows.select("item_id", F.concat_ws(" ", "parts").alias("text"))


def margin_of(words: int) -> int:
    """Words of a document that are looked at on either side of an item of so many words."""
    return 12 + words // 4


def least_pairs(words: int) -> int:
    """The fewest word pairs that ``holds_piece`` lets an item of so many words share."""
    piece = max(2, math.ceil(SHARE * words))
    return max(1, math.ceil(SIMILAR * (piece - 1)))


def window_of(words: int) -> int:
    """The window of an item of so many words; long ones in steps of an eighth, so that sizes stay few."""
    size = max(2, int(WINDOW_SHARE * math.ceil(SHARE * words)))
    grain = max(0, size.bit_length() - 4)
    return size >> grain << grain


class LeakIndex:
    """Fingerprints of all windows of the items' passages by size, with where they stand."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        holders: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for ident, words in items:
            if len(words) > 1:
                holders[tuple(words)].append(ident)
        #: each passage once: its words, its items
        self.passages = [(list(words), sorted(set(ids))) for words, ids in holders.items()]
        self.pairs = [frozenset(zip(words, words[1:])) for words, _ in self.passages]
        flat = [w for words, _ in self.passages for w in words]
        self.hashes = word_hashes(flat)
        self.start = np.cumsum([0, *(len(words) for words, _ in self.passages)])
        sizes = defaultdict(list)
        for k, (words, _) in enumerate(self.passages):
            sizes[window_of(len(words))].append(k)
        self.longest = max(sizes, default=1)
        sums = word_sums(self.hashes, self.longest)
        #: size, place of every stored window in the flat words, passage, index
        self.windows = []
        for size, owners in sorted(sizes.items()):
            place = np.concatenate([np.arange(self.start[k], self.start[k + 1] - size + 1) for k in owners])
            self.windows.append((size, place, np.searchsorted(self.start, place, "right") - 1, HammingIndex(fingerprints(sums, size)[place])))
        #: the words in 16 bits, with room at both ends for drift
        self.short = np.concatenate([np.zeros(DRIFT, np.uint16), self.hashes.astype(np.uint16), np.zeros(DRIFT, np.uint16)])

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(document's position in ``docs``, item_id) of every leak."""
        flat = [w for d in docs for w in d]
        if len(flat) < 2 or not self.windows:
            return
        hashes = word_hashes(flat)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start = np.cumsum([0, *(len(d) for d in docs)])
        sums, short = word_sums(hashes, self.longest), hashes.astype(np.uint16)
        cases = []
        for size, place, owner, index in self.windows:
            step = max(1, size // STARTS)
            at = np.arange(0, len(flat) - size + 1, step)
            inside = doc[at] == doc[at + size - 1]
            at = at[inside]
            asked, stored = index.search(fingerprints(sums, size, step)[inside])
            at, place_of = at[asked], place[stored]
            here, there = sliding_window_view(short, size)[at] if len(at) else np.empty((0, size)), sliding_window_view(self.short, size + 2 * DRIFT)[place_of]
            same = np.max([np.count_nonzero(here == there[:, d : d + size], axis=1) for d in range(2 * DRIFT + 1)], axis=0)
            near = np.flatnonzero(same >= max(2, math.ceil(ALIGNED * size)))
            at, k = at[near], owner[stored[near]]
            cases.append(np.stack([doc[at], k, at - start[doc[at]] - (place_of[near] - self.start[k]), same[near]]))
        case = np.concatenate(cases, axis=1)
        key = case[0] * np.int64(len(self.passages)) + case[1]
        order = np.lexsort((case[2], key))
        key, shifts, same = key[order], case[2][order], case[3][order]
        once = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(shifts, prepend=0) != 0))
        if not len(once):
            return
        key, shifts, votes = key[once], shifts[once], np.add.reduceat(same, once)
        order = np.lexsort((shifts, -votes, key))
        shifts = shifts[order].tolist()
        bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1)).tolist()
        for low, high, case_of in zip(bounds, bounds[1:], key[bounds[:-1]].tolist()):
            d, k = divmod(case_of, len(self.passages))
            if any(self._holds(docs[d], k, s) for s in _apart(shifts[low:high])):
                yield from ((d, i) for i in self.passages[k][1])

    def _holds(self, doc: list[str], k: int, shift: int) -> bool:
        """``holds_piece``, told before by the number of shared word pairs where these are too few or too far apart."""
        words, pairs = self.passages[k][0], self.pairs[k]
        margin = margin_of(len(words))
        part = doc[max(0, shift - margin) : shift + len(words) + margin]
        shared = list(filter(pairs.__contains__, zip(part, part[1:])))
        return len(shared) >= least_pairs(len(words)) and dense_enough(words, set(shared)) and holds_piece(doc, words, shift)


def dense_enough(item: list[str], shared: set[tuple[str, str]]) -> bool:
    """Whether a piece of ``item`` long enough has so many of ``shared`` among its word pairs as ``holds_piece`` asks for.

    A piece shares each of its pairs once at most, so no piece that ``holds_piece`` accepts is refused.
    """
    least = max(2, math.ceil(SHARE * len(item))) - 1
    surplus, lowest, before = [0.0], math.inf, 0.0
    for pair in zip(item, item[1:]):
        before += (pair in shared) - SIMILAR
        surplus.append(before)
        if len(surplus) > least:
            lowest = min(lowest, surplus[-1 - least])
            if before >= lowest - 1e-6:
                return True
    return False


def _apart(shifts: list[int]) -> Iterator[int]:
    """Shifts in their order without those a few words beside an earlier one, which the margin covers."""
    seen: set[int] = set()
    for s in shifts:
        if s not in seen:
            seen.update(range(s - 4, s + 5))
            yield s


def holds_piece(doc: list[str], item: list[str], shift: int) -> bool:
    """Whether ``doc`` has at least a third of ``item`` in one piece around a shift of their words.

    A piece is a chain of common runs with small gaps; its word pairs, each as often as it
    stands in both, must make up most of the item's.
    """
    margin = margin_of(len(item))
    part = doc[max(0, shift - margin) : shift + len(item) + margin]
    need = SHARE * len(item)
    best, chain = 0, None
    for m in SequenceMatcher(None, part, item, autojunk=False).get_matching_blocks():
        if m.size < 2:
            continue
        if chain and m.a - chain[1] <= GAP and m.b - chain[3] <= GAP and abs((m.a - chain[1]) - (m.b - chain[3])) <= SLIP:
            chain = (chain[0], m.a + m.size, chain[2], m.b + m.size)
        else:
            chain = (m.a, m.a + m.size, m.b, m.b + m.size)
        if chain[3] - chain[2] > best:
            a, b = part[chain[0] : chain[1]], item[chain[2] : chain[3]]
            shared = Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))
            if sum(shared.values()) >= SIMILAR * max(1, len(b) - 1):
                best = chain[3] - chain[2]
    return best >= need and best > 1


def find_leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item, whole or a third of it.

    NULL or empty texts and items hold nothing; a repeated row gives no second row; an item's
    other columns and the documents' are not read. Documents never leave their partition; they
    are read once for every ``block`` words of passages, whose index is what is broadcast.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("doc_id is not null and length(text) > 0")

    def scan(part: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(LeakIndex(part))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found, held, ids, n = [], [], [], 0
                for ident, text in zip(batch["doc_id"], batch["text"]):
                    held.append(text)
                    ids.append(ident)
                    n += len(text)
                    if n > 6 * CHUNK_WORDS:
                        found.extend((ids[d], i) for d, i in shared.value.search(words_of(held)))
                        held, ids, n = [], [], 0
                if held:
                    found.extend((ids[d], i) for d, i in shared.value.search(words_of(held)))
                yield pd.DataFrame(found, columns=["doc_id", "item_id"], dtype="int64")

        return docs.mapInPandas(run, "doc_id bigint, item_id bigint")

    out, part, n = None, [], 0
    for r in own_passages(items).orderBy("text", "item_id").toLocalIterator():
        part.append((r.item_id, words_of([r.text])[0]))
        n += len(part[-1][1])
        if n >= block:
            out, part, n = scan(part) if out is None else out.unionByName(scan(part)), [], 0
    if part or out is None:
        out = scan(part) if out is None else out.unionByName(scan(part))
    return out.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds an item's own passage, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents its passage leaked into."""
    leaks = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, sf_dir, "eval_item").select("item_id").distinct().join(leaks, "item_id", "left").na.fill(0, ["documents"])
