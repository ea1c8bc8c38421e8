"""Noise in text from scanned pages: find it, and repair the text into readable paragraphs.

Method: the vocabulary of the corpus's typeset books is a trie; for every word type of the
scanned books that is not surely known, the Levenshtein automaton of the word is run over the
whole trie, which gives every vocabulary word the score could accept within two steps. A step is
an edit or one character read as two or two as one; what a step costs is learned from the
scanned books' own unknown words, so a candidate is never refused by a list. A word is misread
where a printed vocabulary word and its misreading are more probable than a new word (by letter
pairs) or the rare word as it stands. Candidates are ranked by cost, frequency and the words
beside them; page furniture is taken out and the lines reflowed into paragraphs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.p1_markup import convert
from lectern.llm.p2_sitelines import MIN_CHAPTERS, chapter_lines
from lectern.session import small, table, written

#: A book is from scans if this share of its elements holds line breaks.
BROKEN_SHARE = 0.4
#: A word is in the vocabulary where typeset books hold it this often, parts of a joined word where more often;
#: it is surely right from this share of all words on, and weighed against its misreadings below.
KNOWN, PART, SURE = 2, 3, 1e-5
EDITS = 2
#: A task gets the trie of so many vocabulary words, and so many unknown word types.
VOCABULARY_BLOCK, TYPES_BLOCK = 200_000, 4_000
#: So many of the most frequent words are left out before rows are made of words; a join leaves out the rest.
COMMON = 20_000
#: Misreadings and letter pairs under this share of all are unseen, which bounds the tables (10,000 and 100,000 rows).
OP_SHARE, GRAM_SHARE = 1e-4, 1e-5
#: An unseen misreading counts as PRIOR sightings shared by READINGS possible ones.
PRIOR, READINGS = 10.0, 100.0
#: An option so much less probable (as a logarithm) than the best one is none.
RIVAL = 8.0
#: The weight of a word's own frequency beside the pairs it stands in (in sightings).
CONTEXT = 0.01

PAGE_NUMBER = re.compile(r"^\W*(?:(?:pg|p|page)\b\.?\s*)?\d{1,4}\W*$", re.I)
LETTERS = re.compile(r"[^\W\d_]")
TOKEN = re.compile(r"(?:[^\W_]++|\|)++(?:-(?:[^\W_]++|\|)++)*+")
ENDS_SPLIT = re.compile(r"((?:[^\W_]|\|)+(?:-(?:[^\W_]|\|)+)*)([-‐¬­])\s*$")
STARTS_LOWER = re.compile(r"^[\s«“\"'(]*[a-zß-öø-ÿ|ſ]")
CLOSED = re.compile(r"(?<!,)[.!?…»”\"][\s»”\"')\]]*$")
ORDINAL = re.compile(r"^\d+(?:er|re|e|ème|st|nd|rd|th|s)?$")
DASH_END = re.compile(r"[-‐¬­]$")
SMALL = re.compile(r"[a-z]")


def _title_key(title: str | None) -> str:
    return "".join(LETTERS.findall((title or "").replace("_", " "))).casefold()


def ends_split(line: str) -> re.Match | None:
    """``ENDS_SPLIT`` in a line, which is looked through only where it ends in a hyphen."""
    return ENDS_SPLIT.search(line) if DASH_END.search(line.rstrip()[-1:]) else None


def _near(a: str, b: str, most: int) -> bool:
    """Whether two keys differ in at most ``most`` places (same length or one more)."""
    if abs(len(a) - len(b)) > 1:
        return False
    return sum(x != y for x, y in zip(a, b)) <= most or sum(x != y for x, y in zip(a[::-1], b[::-1])) <= most


def is_header(line: str, titles: list[str]) -> bool:
    """A line in capitals that bears a title of the book or chapter, misread here and there;
    behind a dash the author may follow, before or after it a page number."""
    if SMALL.search(line):
        return False
    body = re.sub(r"^\W*\d{0,4}\s+(?=\S)|\s+\d{1,4}\W*$", "", line.strip())
    if not LETTERS.search(body) or body != body.upper():
        return False
    whole = "".join(LETTERS.findall(body.translate(str.maketrans("0158", "oisb")).casefold()))
    title = "".join(LETTERS.findall(re.split(r"\s[—–-]\s", body)[0].translate(str.maketrans("0158", "oisb")).casefold()))
    return any(t and (_near(title, t, 1 + len(t) // 12) or len(t) >= 12 and _near(whole[: len(t)], t, 1 + len(t) // 12)) for t in titles)


class Page:
    """The elements of one chapter taken apart: furniture, site lines, prose by paragraph."""

    def __init__(self, paragraphs: list[str | None], titles: list[str], site: set[tuple[int, int]]):
        self.kinds: set[tuple[int, str]] = set()
        #: paragraphs of the book: lists of (element, line)
        self.prose: list[list[tuple[int, str]]] = []
        self.site: list[tuple[int, str]] = []
        furniture, open_ = False, False
        for p, text in enumerate(paragraphs):
            lines = []
            for j, line in enumerate((text or "").split("\n")):
                if (p, j) in site:
                    self.site.append((p, line))
                elif PAGE_NUMBER.match(line):
                    self.kinds.add((p, "pageno"))
                    furniture = furniture or not lines
                elif is_header(line, titles):
                    self.kinds.add((p, "header"))
                    furniture = furniture or not lines
                elif line.strip():
                    lines.append((p, line))
            if not lines:
                continue
            if self.prose and furniture and (open_ or STARTS_LOWER.match(lines[0][1])):
                self.kinds.add((p, "cont"))
                self.prose[-1].extend(lines)
            else:
                self.prose.append(lines)
            open_, furniture = not CLOSED.search(lines[-1][1].rstrip()), False

    def words(self) -> Iterator[tuple[int, str, str | None, str | None]]:
        """(element, word, compound, hyphen): the words of the prose, split words put together.

        A word that a hyphen parts at the end of a line comes joined, with the hyphenated form
        beside it; which of the two was meant is decided later.
        """
        for lines in self.prose:
            carry: tuple[int, str, str] | None = None
            for p, line in lines:
                at, split = 0, ends_split(line)
                if carry:
                    first = TOKEN.match(line.lstrip())
                    start, head, mark = carry
                    if first and (first.group()[0].islower() or first.group()[0] in "|ſ" or first.group()[0].isdigit() and not first.group().isdigit()):
                        whole_line = first.end() + len(line) - len(line.lstrip())
                        tail = first.group()
                        at = whole_line
                        if split and split.start(1) < at:
                            carry = (start, head + tail, split.group(2))
                            continue
                        yield start, head + tail, f"{head}-{tail}", mark
                    else:
                        yield start, head, None, None
                    carry = None
                end = split.start(1) if split else len(line)
                for token in TOKEN.findall(line, at, end):
                    yield p, token, None, None
                if split:
                    carry = (p, split.group(1), split.group(2))
            if carry:
                yield carry[0], carry[1], None, None


# --- vocabulary: a trie and the automata of words ----------------------------------------


class Confusions:
    """What steps cost, and how probable words are: learned tables, small enough to be shared with every task."""

    def __init__(self, grams: dict[str, float] | None = None, words: float = 0.0, new: float = 0.0, ops: dict[tuple[str, str], float] | None = None, joins: float = 0.0, scale: float = 1.0):
        #: sightings of letters and letter pairs (^ and $ are the ends of a word) in the typeset books
        self.grams, self.words, self.new = grams or {}, words, new
        #: sightings of letters in the scanned books are these times ``scale``
        self.scale, self.sightings = scale, ops or {}
        self.letters = sum(n for g, n in self.grams.items() if len(g) == 1)
        self.ops = {(a, b): self._cost(a, n) for (a, b), n in self.sightings.items()}
        self.join = -math.log((joins + PRIOR / READINGS) / (words * scale + PRIOR))
        best: dict[str, tuple[float, str]] = {}
        for (a, b), n in self.sightings.items():
            if len(a) == len(b) == 1:
                best[b] = max(best.get(b, (0.0, "")), (n, a))
        self.meant = str.maketrans({b: a for b, (_, a) in best.items()})

    def _cost(self, right: str, n: float) -> float:
        return -math.log(min(1.0, (n + PRIOR / READINGS) / ((self.grams.get(right, 0.0) if right else self.letters) * self.scale + PRIOR)))

    def unseen(self, right: str) -> float:
        return self._cost(right, 0.0)

    def frequency(self, n: float) -> float:
        """log probability of a word of ``n`` sightings."""
        return math.log(n / max(self.words, n))

    def as_it_stands(self, word: str, n: float) -> float:
        """log probability that ``word`` is what was printed: a new word by its letter pairs, or one seen ``n`` times."""
        total = math.log((self.new + 0.5) / (self.words + 1.0))
        for x, y in zip("^" + word, word + "$"):
            total += math.log((self.grams.get(x + y, 0.0) + PRIOR * 1e-4) / (self.grams.get(x, 0.0) + PRIOR))
        return max(total, self.frequency(n)) if n else total


class Trie:
    """A trie whose nodes are numbered level by level, and the Levenshtein automata of many words run over it at once."""

    def __init__(self, words: dict[str, int]):
        self.words, self.counts = sorted(w for w in words if w), words
        self.alphabet = {c: k for k, c in enumerate(sorted({c for w in self.words for c in w}))}
        self.size = len(self.alphabet) + 1
        length = np.array([len(w) for w in self.words], dtype=np.int64)
        codes = np.array([self.alphabet[c] for w in self.words for c in w], dtype=np.int64)
        start, node = np.concatenate([[0], np.cumsum(length)]), np.zeros(len(length), dtype=np.int64)
        keys, ends, n = [np.empty(0, np.int64)], [np.array([-1])], 1
        for depth in range(length.max(initial=0)):
            own = np.flatnonzero(length > depth)
            level, inverse = np.unique(node[own] * self.size + codes[start[own] + depth], return_inverse=True)
            node[own] = n + inverse
            end = np.full(len(level), -1)
            last = length[own] == depth + 1
            end[inverse[last]] = own[last]
            keys.append(level)
            ends.append(end)
            n += len(level)
        #: the key of node k + 1 is its parent and character; ``end`` is the word that ends at a node
        self.keys, self.end = np.concatenate(keys), np.concatenate(ends)
        self.char = self.keys % self.size
        self.first = np.searchsorted(self.keys // self.size, np.arange(n + 1))
        #: how many characters follow a node, at least and at most
        self.least, self.most = np.where(self.end >= 0, 0, 1 << 40), np.where(self.end >= 0, 0, -1)
        for low, high in reversed(list(zip(np.cumsum([1, *map(len, keys[1:-1])]), np.cumsum(list(map(len, keys[1:])))  + 1))):
            parent = self.keys[low - 1 : high - 1] // self.size
            np.minimum.at(self.least, parent, self.least[low:high] + 1)
            np.maximum.at(self.most, parent, self.most[low:high] + 1)

    def _child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by a character, -1 where there is none."""
        key = node * self.size + code
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        return np.where(hit & (node >= 0), at + 1, -1)

    def search(self, words: list[str], costs: Confusions, budget: list[float], steps: int = EDITS, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, vocabulary word, least cost) of all pairs within ``steps`` steps and the word's budget.

        A state is a word, a node, how much of the word is read, the steps so far and their cost.
        """
        length = np.array([len(w) for w in words], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(length + 1)])
        code = np.array([k for w in words for k in [*(self.alphabet.get(c, self.size - 1) for c in w), self.size - 1]], dtype=np.int64)
        limit = np.array(budget, dtype=np.float64) + 1e-9
        unseen = np.array([costs.unseen(c) for c in self.alphabet] + [0.0])
        added, cheapest = costs.unseen(""), min([costs.unseen(""), *unseen[:-1]])
        # learned steps that the text allows at each place: first and second right character, characters read, cost
        by_read: dict[str, list[tuple[int, int, int, float]]] = {}
        for (a, b), cost in costs.ops.items():
            if all(c in self.alphabet for c in a):
                right = [self.alphabet[c] for c in a]
                by_read.setdefault(b, []).append((right[0] if right else -1, right[1] if len(right) > 1 else -1, len(b), cost))
        counts, listed = [], []
        for w in words:
            for j in range(len(w) + 1):
                here = [o for b in dict.fromkeys(("", w[j : j + 1], w[j : j + 2])) if len(b) <= len(w) - j for o in by_read.get(b, ())]
                counts.append(len(here))
                listed.extend(here)
        counts = np.array(counts, dtype=np.int64)
        offset = np.cumsum(counts) - counts
        first, second, read, price = (np.array(x) for x in zip(*listed)) if listed else (np.empty(0, np.int64),) * 4
        w = np.flatnonzero(length > 0)
        n, j, s, c = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w))
        found = []
        while len(w):
            done = (j == length[w]) & (self.end[n] >= 0)
            found.append((w[done], self.end[n[done]], c[done]))
            place = start[w] + j
            moves = []
            inside = np.flatnonzero(j < length[w])
            moves.append((w[inside], self._child(n[inside], code[place[inside]]), j[inside] + 1, s[inside], c[inside]))
            more = np.flatnonzero(s < steps)
            if len(more) and len(listed):
                k = counts[place[more]]
                row = np.repeat(more, k)
                op = np.arange(len(row)) - np.repeat(np.cumsum(k) - k - offset[place[more]], k)
                fits = c[row] + price[op] <= limit[w[row]]
                row, op = row[fits], op[fits]
                node = n[row]
                node = np.where(first[op] >= 0, self._child(node, first[op]), node)
                node = np.where(second[op] >= 0, self._child(node, second[op]), node)
                moves.append((w[row], node, j[row] + read[op], s[row] + 1, c[row] + price[op]))
            more = more[c[more] + cheapest <= limit[w[more]]]
            if len(more):
                left = length[w[more]] - j[more]
                one = more[left > 0]
                moves.append((w[one], n[one], j[one] + 1, s[one] + 1, c[one] + added))
                row, child = self._children(more, n[more])
                cost = c[row] + unseen[self.char[child - 1]]
                fits = cost <= limit[w[row]]
                row, child, cost = row[fits], child[fits], cost[fits]
                left = length[w[row]] - j[row]
                for b in range(3 if pairs else 2):
                    some = left >= b
                    moves.append((w[row[some]], child[some], j[row[some]] + b, s[row[some]] + 1, cost[some]))
                if pairs:
                    at, grandchild = self._children(np.flatnonzero(left > 0), child[left > 0])
                    moves.append((w[row[at]], grandchild, j[row[at]] + 1, s[row[at]] + 1, cost[at]))
            w, n, j, s, c = (np.concatenate(x) for x in zip(*moves))
            left = length[w] - j
            good = (n >= 0) & (c <= limit[w]) & (self.least[n] - left <= steps - s) & (left - self.most[n] <= steps - s)
            w, n, j, s, c = w[good], n[good], j[good], s[good], c[good]
            state = ((w * len(self.end) + n) * (length.max(initial=0) + 1) + j) * (steps + 1) + s
            order = np.lexsort((c, state))
            order = order[np.diff(state[order], prepend=-1) != 0]
            w, n, j, s, c = w[order], n[order], j[order], s[order], c[order]
        w, v, c = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((c, v, w))
        order = order[np.diff((w * max(1, len(self.words)) + v)[order], prepend=-1) != 0]
        return w[order], v[order], c[order]

    def _children(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, child) of every child of each node."""
        n = self.first[node + 1] - self.first[node]
        return np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[node], n) + 1

    def within(self, word: str) -> list[str]:
        """All words of the trie within ``EDITS`` edits of ``word``."""
        plain = Confusions()
        return [self.words[v] for v in self.search([word], plain, [EDITS * plain.unseen("")], pairs=False)[1]] if word else []


def difference(right: str, read: str) -> tuple[str, str]:
    """What of ``right`` stands otherwise in ``read``, without their common beginning and end."""
    i = 0
    while i < min(len(right), len(read)) and right[i] == read[i]:
        i += 1
    j = 0
    while j < min(len(right), len(read)) - i and right[-1 - j] == read[-1 - j]:
        j += 1
    return right[i : len(right) - j], read[i : len(read) - j]


def candidates(words: list[str], own: list[float], best: list[float], trie: Trie, costs: Confusions) -> list[tuple[str, float, float, str]]:
    """(word, cost, log frequency, right word) of all vocabulary words the score prefers to ``word`` as it stands.

    ``own`` is how often the vocabulary has the word itself, ``best`` the improbability of its best
    halves. The budget of the automaton is what the score could accept of the most frequent word
    (of a length the steps can reach) beside the best option known, so nothing acceptable is left out.
    """
    top: dict[int, int] = {}
    for v in trie.words:
        top[len(v)] = max(top.get(len(v), 0), trie.counts[v])
    out = []
    for low in range(0, len(words), 64):
        part = words[low : low + 64]
        stands = [costs.as_it_stands(w, n) for w, n in zip(part, own[low : low + 64])]
        rival = [b if b == b else math.inf for b in best[low : low + 64]]
        for steps in range(1, EDITS + 1):
            most = [costs.frequency(max([1, *(top.get(len(w) + d, 0) for d in range(-steps, steps + 1))])) for w in part]
            budget = [max(-1.0, m + min(-h, r + RIVAL)) for m, h, r in zip(most, stands, rival)]
            found = [(w, c, costs.frequency(trie.counts[trie.words[v]]), trie.words[v]) for w, v, c in zip(*(x.tolist() for x in trie.search(part, costs, budget, steps)))]
            found = [f for f in found if f[3] != part[f[0]] and f[2] - f[1] > stands[f[0]]]
            for w, c, p, _ in found:
                rival[w] = min(rival[w], c - p)
        out.extend((part[w], c, p, right) for w, c, p, right in found if c - p <= rival[w] + RIVAL)
    return out


def splits(word: str, costs: Confusions) -> list[tuple[str, str]]:
    """Every way to take ``word``, as it stands or with its foreign signs as letters, for two words run together."""
    texts = {word, word.translate(costs.meant)} if foreign(word, costs) else {word}
    halves = ((text[:i], text[i:]) for text in texts for i in range(1, len(text)))
    return [h for h in halves if all(len(x) > 1 or x in "aày" for x in h)]


def foreign(word: str, costs: Confusions) -> bool:
    """Whether a word, most of it letters, has signs or forms of letters that no typeset word has."""
    odd = lambda c: c not in costs.grams and c != "-" and (not c.isalpha() or unicodedata.normalize("NFKC", c) != c)
    return any(map(odd, word)) and not ORDINAL.match(word) and sum(c.isalpha() for c in word) * 2 >= len(word)


def verdict(word: str, n: float, options: list[tuple[float, float, str]], costs: Confusions) -> tuple[str | None, list[tuple[str, float, float]]]:
    """(kind, repairs) of an unknown word by its candidates and halves over the whole vocabulary.

    Options and repairs are (cost, log frequency, text) and (text, cost, log frequency); the most
    probable option tells the kind, and all of that kind are kept, the best first: the context has the last word.
    """
    if ORDINAL.match(word):
        return None, []
    stands = costs.as_it_stands(word, n)
    signs = foreign(word, costs)
    ranked = sorted(((c - p, t, c, p) for c, p, t in options if p - c > stands), key=lambda o: o[:2])
    ranked = [o for o in ranked if o[0] <= ranked[0][0] + RIVAL]
    if ranked and len(word) > 1:
        joined = " " in ranked[0][1]
        kind = "joined" if joined and not signs else "misread"
        return kind, [(t, c, p) for _, t, c, p in ranked if (" " in t) == joined]
    if signs:
        return "misread", [(word.translate(costs.meant), 0.0, 0.0)]
    return None, []


def correct(word: str, trie: Trie, costs: Confusions | None = None) -> tuple[str | None, list[str]]:
    """(kind, repairs) of an unknown word in small letters: 'misread', 'joined' or None."""
    costs = costs or learned(trie.counts.items())
    parts = ((trie.counts.get(a, 0), trie.counts.get(b, 0), f"{a} {b}") for a, b in splits(word, costs))
    options = [(costs.join, costs.frequency(na) + costs.frequency(nb), h) for na, nb, h in parts if na >= PART and nb >= PART]
    best, n = min((c - p for c, p, _ in options), default=math.inf), trie.counts.get(word, 0)
    kind, repairs = verdict(word, n, options + [o[1:] for o in candidates([word], [n], [best], trie, costs)], costs)
    return kind, [t for t, _, _ in repairs]


def learned(counts, **more) -> Confusions:
    """The tables of a small vocabulary, given as (word, sightings)."""
    grams: dict[str, float] = {}
    total = 0.0
    for word, n in counts:
        total += n
        for g in ["^", *word, *(x + y for x, y in zip("^" + word, word + "$"))]:
            grams[g] = grams.get(g, 0.0) + n
    return Confusions(grams, words=total, **more)


def _over(unknown: DataFrame, vocabulary: DataFrame, rows_of, columns: str, types: int, words: int) -> DataFrame:
    """Rows of ``rows_of(words, sightings, best, trie)`` for every block of types with every block of the vocabulary.

    Each task holds one block of both; nothing passes the driver. The numbers of blocks grow with the
    tables, and candidates of several blocks are put together by the caller.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    parts, blocks = max(1, -(-types // TYPES_BLOCK)), max(1, -(-words // VOCABULARY_BLOCK))
    left = unknown.select("word", "n", "best", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"))
    group = lambda df: df.repartition(parts * blocks, "part", "block").groupBy("part", "block")

    def run(types: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(types["word"].tolist(), types["n"].tolist(), types["best"].tolist(), Trie(dict(zip(words["word"], words["n"].tolist())))) if len(types) else []
        return pd.DataFrame(rows, columns=names)

    return group(left).cogroup(group(right)).applyInPandas(run, columns)


def learn(unknown: DataFrame, vocabulary: DataFrame, hapaxes: float = 0.0, scale: float = 1.0) -> tuple[Confusions, DataFrame]:
    """What is misread for what, from the unknown word types (word, n, seen) one step from vocabulary words; and their halves.

    Each type's sightings are shared by its candidates, first by their frequency, then twice by
    frequency and how often that misreading was seen.
    """
    ends = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length("word") + 2 - k), lambda i: F.substring(ends, i, F.lit(k)))
    grams = vocabulary.select("n", F.explode(F.concat(at(1), at(2))).alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    total = vocabulary.agg(F.sum("n").alias("words"), F.count("*").alias("types")).first()
    grams = written(grams, "grams")
    all_grams = grams.agg(F.sum("n")).first()[0] or 0
    tables = {"grams": {r.g: float(r.n) for r in grams.filter(F.col("n") >= GRAM_SHARE * all_grams).toLocalIterator()}, "words": float(total.words or 0), "new": hapaxes, "scale": scale}
    plain = Confusions()
    pair = "word string, right string, n bigint, a string, b string"
    types = unknown.count()

    def near(words: list[str], _n, _best, trie: Trie) -> list[tuple]:
        out = []
        for low in range(0, len(words), 64):
            w, v, _c = trie.search(words[low : low + 64], plain, [plain.unseen("")] * len(words[low : low + 64]), steps=1)
            for k, right in zip(w.tolist(), (trie.words[x] for x in v.tolist())):
                if right != words[low + k]:
                    out.append((words[low + k], right, trie.counts[right], *difference(right, words[low + k])))
        return out

    fresh = unknown.filter("n = 0 and seen > 0")
    cases = _over(fresh.withColumn("best", F.lit(0.0)), vocabulary, near, pair, types, total.types).join(fresh.select("word", "seen"), "word")
    cases = written(cases.withColumn("weight", F.col("n").cast("double")), "near")
    by_word = Window.partitionBy("word")
    shared = F.col("seen") * F.col("weight") / F.sum("weight").over(by_word)
    ops = cases.withColumn("c", shared).groupBy("a", "b").agg(F.sum("c").alias("c"))
    for _ in range(2):
        ops = written(ops, "confusions")
        ops = cases.join(ops, ["a", "b"]).withColumn("weight", F.col("n") * F.col("c")).withColumn("c", shared).groupBy("a", "b").agg(F.sum("c").alias("c"))
    ops = written(ops, "confusions")
    mass = ops.agg(F.sum("c")).first()[0] or 0.0
    sightings = {(r.a, r.b): r.c for r in ops.filter(F.col("c") >= OP_SHARE * mass).toLocalIterator()}
    halves = written(_halves(unknown, vocabulary, Confusions(**tables, ops=sightings)), "halves")
    joins = fresh.join(halves.select("word").distinct(), "word").join(cases.select("word").distinct(), "word", "left_anti").agg(F.sum("seen")).first()[0] or 0
    return Confusions(**tables, ops=sightings, joins=float(joins)), halves


def _halves(unknown: DataFrame, vocabulary: DataFrame, costs: Confusions) -> DataFrame:
    """(word, a, b, na, nb): words as two frequent words run together, by equality of the halves."""

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, *h) for w in batch["word"] for h in splits(w, costs)], columns=["word", "a", "b"])

    frequent = vocabulary.filter(F.col("n") >= PART)
    halves = unknown.select("word").mapInPandas(halve, "word string, a string, b string")
    for side in "ab":
        halves = halves.join(frequent.select(F.col("word").alias(side), F.col("n").alias("n" + side)), side)
    return halves


TYPES = "word string, kind string, repairs array<struct<text: string, cost: double, p: double>>"


def word_types(unknown: DataFrame, vocabulary: DataFrame, hapaxes: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(word, kind, repairs): what the unknown word types are.

    ``unknown`` has the types and, as ``seen``, their sightings in scanned books (else one each).
    ``hapaxes`` and the vocabulary's own counts tell how probable new words are; ``scale`` is how
    much text the scanned books have beside the typeset ones.
    """
    seen = F.col("seen") if "seen" in unknown.columns else F.lit(1)
    types = unknown.select("word", seen.cast("bigint").alias("seen")).join(vocabulary.select("word", "n"), "word", "left").na.fill(0, ["n"])
    types = written(types, "unknown")
    costs, halves = learn(types, vocabulary, hapaxes, scale)
    option = "word string, cost double, p double, text string"
    total = max(costs.words, 1.0)
    halves = halves.select("word", F.lit(costs.join).alias("cost"), (F.log(F.col("na") / total) + F.log(F.col("nb") / total)).alias("p"), F.concat_ws(" ", "a", "b").alias("text"))
    types = types.join(halves.groupBy("word").agg(F.min(F.col("cost") - F.col("p")).alias("best")), "word", "left")
    rows = _over(types, vocabulary, lambda words, own, best, trie: candidates(words, own, best, trie, costs), option, types.count(), vocabulary.count())
    none = types.select("word", *(F.lit(None).cast(t).alias(c) for c, t in (("cost", "double"), ("p", "double"), ("text", "string"))))
    options = rows.unionByName(halves).unionByName(none).groupBy("word").agg(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("cost", "p", "text"))).alias("options"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, n, found in zip(batch["word"], batch["n"], batch["options"]):
                kind, repairs = verdict(w, n, [(o["cost"], o["p"], o["text"]) for o in found], costs)
                out.append((w, kind, [{"text": t, "cost": c, "p": p} for t, c, p in repairs]))
            yield pd.DataFrame(out, columns=["word", "kind", "repairs"])

    return options.join(types.select("word", "n"), "word").mapInPandas(judge, TYPES).filter("kind is not null")


# --- the pipeline -------------------------------------------------------------------------


def scanned_editions(chapters: DataFrame) -> DataFrame:
    """(edition_id, chars) of books from scans, by their own text (the stated flag is often wrong)."""
    chars = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))).alias("chars")
    n = chapters.filter("edition_id is not null and paragraphs is not null").select("edition_id", F.size("paragraphs").alias("n"), F.size(F.filter("paragraphs", lambda p: p.contains("\n"))).alias("broken"), chars)
    n = n.groupBy("edition_id").agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"), F.sum("chars").alias("chars"))
    return n.filter(F.col("broken") >= BROKEN_SHARE * F.col("n")).filter("n > 0").select("edition_id", "chars")


def vocabulary_of(chapters: DataFrame, scans: DataFrame) -> DataFrame:
    """(word, n): words of the books not from scans, in small letters, with how often they stand there."""
    text = chapters.join(scans, "edition_id", "left_anti").select(F.explode("paragraphs").alias("t"))
    words = text.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def scan_pages(chapters: DataFrame, editions: DataFrame, books: DataFrame, scans: DataFrame) -> DataFrame:
    """(chapter_id, paragraphs, titles, site): chapters of scanned books with what their furniture is told by."""
    sources = editions.filter("edition_id is not null").groupBy("edition_id").agg(F.min("source").alias("source"), F.min("page").alias("page"))
    info = books.filter("edition_id is not null").groupBy("edition_id").agg(F.min("title").alias("book"))
    lines_of = lambda rows: chapter_lines(rows.filter("chapter_id is not null")).join(sources.select("edition_id", "source"), "edition_id")
    lines = lines_of(chapters)
    keys = lines.filter("source is not null").select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
    hot = keys.groupBy("source", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_CHAPTERS).select("source", "k")
    hot = small(written(hot, "sitekeys"))
    mine = lines_of(chapters.join(scans, "edition_id", "left_semi")).select("chapter_id", "source", F.explode("lines").alias("x")).select("chapter_id", "source", F.col("x.k").alias("k"), F.col("x.p").alias("p"), F.col("x.l").alias("l"))
    site = mine.join(hot, ["source", "k"], "left_semi").groupBy("chapter_id").agg(F.collect_list(F.struct("p", "l")).alias("site"))
    site = written(site, "site")  # the pages are read twice by the repair; all chapters' lines only once
    pages = chapters.filter("chapter_id is not null and paragraphs is not null").join(scans, "edition_id", "left_semi")
    pages = pages.select("chapter_id", "edition_id", "title", "paragraphs").join(sources, "edition_id", "left").join(info, "edition_id", "left")
    return pages.join(site, "chapter_id", "left").select("chapter_id", "paragraphs", F.array("title", "page", "book").alias("titles"), "site")


def _page(paragraphs, titles, site) -> Page:
    keys = [_title_key(convert(t)[0]) for t in titles if t]
    places = {(s["p"], s["l"]) for s in site} if site is not None else set()
    return Page(list(paragraphs), keys, places)


PAGE_ROWS = "chapter_id bigint, p_idx bigint, kind string, word string, compound string, before string, after string"


def page_rows(batches: Iterator[pd.DataFrame], common: set[str] | frozenset = frozenset()) -> Iterator[pd.DataFrame]:
    """Rows of furniture and continuation, and of every word ('word') with its neighbours.

    ``common`` words are left out early; the caller leaves out all known words anyway.
    """
    names = [c.split()[0] for c in PAGE_ROWS.split(", ")]
    for batch in batches:
        rows = []
        for ident, paragraphs, titles, site in zip(batch["chapter_id"], batch["paragraphs"], batch["titles"], batch["site"]):
            page = _page(paragraphs, titles, site)
            rows.extend((ident, p, kind, None, None, None, None) for p, kind in page.kinds)
            words = [(p, w.lower(), c and c.lower(), mark) for p, w, c, mark in page.words() if not w.isdigit()]
            for k, (p, w, c, mark) in enumerate(words):
                if not mark and w in common:
                    continue
                around = words[k - 1][1] if k else None, words[k + 1][1] if k + 1 < len(words) else None
                rows.append((ident, p, "split" if mark == "-" else "cut" if mark else "word", w, c, *around))
        yield pd.DataFrame(rows, columns=names)


class ScanNoise:
    """The noise of the scanned books' chapters, found step by step and kept as written tables."""

    def __init__(self, chapters: DataFrame, editions: DataFrame, books: DataFrame):
        chapters = chapters.select("chapter_id", "edition_id", "title", "paragraphs")
        scans = small(written(scanned_editions(chapters), "scans"))
        printed = written(vocabulary_of(chapters, scans), "vocabulary")
        self.vocabulary = printed.filter(F.col("n") >= KNOWN)
        size = printed.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.sum((F.length("word") + 1) * F.col("n")).alias("chars")).first()
        sure = self.vocabulary.filter(F.col("n") >= SURE * (size.n or 0))
        self.clean = chapters.join(scans, "edition_id", "left_anti")
        self.pages = scan_pages(chapters, editions, books, scans)
        common = chapters.sparkSession.sparkContext.broadcast(frozenset(r.word for r in sure.orderBy(F.desc("n"), "word").limit(COMMON).toLocalIterator()))
        rows = self.pages.mapInPandas(lambda batches: page_rows(batches, common.value), PAGE_ROWS)
        known = small(sure.select("word", F.lit(True).alias("known")))
        rows = rows.join(known, "word", "left").filter("known is null or kind <> 'word'")
        self.rows = written(rows, "noise")
        words = self.rows.filter("word is not null")
        hyphened = words.filter("kind = 'word' and word like '%-%'").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2").select(F.col("word").alias("compound"))
        hyphened = hyphened.unionByName(self.vocabulary.filter("word like '%-%'").select(F.col("word").alias("compound"))).distinct()
        self.compounds = small(written(hyphened, "compounds"))
        meant = self.rows.filter("kind = 'split'").join(self.compounds, "compound", "left_anti")
        self.splits = self.rows.filter("kind = 'cut'").unionByName(meant.select(*self.rows.columns))
        parts = words.filter("kind = 'word'").join(self.compounds.select(F.col("compound").alias("word")), "word", "left_anti").unionByName(self.splits.filter("known is null").select(*self.rows.columns))
        parts = parts.withColumn("part", F.explode(F.split("word", "-"))).filter("length(part) > 1 and part rlike '[\\\\p{L}]'")
        own = self.compounds.select(F.explode(F.split("compound", "-")).alias("word")).distinct().withColumn("n", F.lit(KNOWN).cast("bigint"))
        full = written(self.vocabulary.unionByName(own).groupBy("word").agg(F.max("n").alias("n")), "words")
        self.suspects = written(_unknown(parts, sure.select("word").unionByName(own.select("word")).distinct()), "suspects")
        types = self.suspects.groupBy(F.col("part").alias("word")).agg(F.count("*").alias("seen"))
        in_scans = scans.agg(F.sum("chars")).first()[0] or 0
        self.types = written(word_types(types, full, float(size.once), in_scans / max(1, size.chars or 0)), "types")

    def found(self) -> DataFrame:
        furniture = self.rows.filter("kind in ('header', 'pageno', 'cont')").select("chapter_id", "p_idx", "kind")
        hyphens = self.splits.select("chapter_id", "p_idx", F.lit("hyphen").alias("kind"))
        words = self.suspects.join(small(self.types.select(F.col("word").alias("part"), F.col("kind").alias("what"))), "part").select("chapter_id", "p_idx", F.col("what").alias("kind"))
        return furniture.unionByName(hyphens).unionByName(words).distinct()


def _unknown(parts: DataFrame, full: DataFrame) -> DataFrame:
    known = small(written(full.select(F.col("word").alias("part")), "known"))
    return parts.join(known, "part", "left_anti").select("chapter_id", "p_idx", "part", "before", "after")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a scanned book's chapter with each kind of noise in it."""
    t = lambda name: table(spark, sf_dir, name)
    return ScanNoise(t("chapter"), t("edition"), t("book_info")).found()


# --- repair -------------------------------------------------------------------------------


def choices(noise: ScanNoise) -> DataFrame:
    """(part, before, repair): the most probable repair of a word behind a word, by what typeset books
    put behind that word, by frequency and by what the misreading costs."""
    cases = noise.suspects.join(small(noise.types.withColumnRenamed("word", "part")), "part").select("part", "before", "repairs").distinct()
    open_ = cases.filter((F.size("repairs") > 1) & F.col("before").isNotNull())
    wanted = small(written(open_.select("before", F.explode("repairs.text").alias("word")).distinct(), "context"))
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))
    text = noise.clean.select(F.explode("paragraphs").alias("t")).select(words.alias("w")).filter(F.size("w") > 1)
    pairs = text.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("before"), b.alias("word")))).alias("p")).select("p.*")
    seen = small(written(pairs.join(wanted, ["before", "word"], "left_semi").groupBy("before", "word").agg(F.count("*").alias("n")), "seen"))
    ranked = cases.select("part", "before", F.explode("repairs").alias("r")).select("part", "before", F.col("r.text").alias("word"), "r.cost", "r.p").join(seen, ["before", "word"], "left")
    probable = F.log(F.coalesce("n", F.lit(0)) + CONTEXT * F.exp("p")) - F.col("cost")
    return ranked.groupBy("part", "before").agg(F.min_by("word", F.struct(-probable, "word")).alias("repair"))


def rebuild(page: Page, repairs: dict[tuple[int, str], str], own: set[str]) -> list[str]:
    """A chapter's paragraphs: furniture and site lines gone, lines reflowed, words whole and corrected."""

    def mend(p: int, token: str) -> str:
        parts = []
        for part in token.split("-"):
            right = repairs.get((p, part.lower()))
            if right and part[:1].isupper():
                right = right[:1].upper() + right[1:]
            parts.append(right or part)
        return "-".join(parts)

    out = []
    for lines in page.prose:
        text: list[str] = []
        carry: tuple[int, str, str] | None = None
        for p, line in lines:
            line = line.strip()
            split = ends_split(line)
            if carry:
                first = TOKEN.match(line)
                start, head, mark = carry
                if first and (first.group()[0].islower() or first.group()[0] in "|ſ" or first.group()[0].isdigit() and not first.group().isdigit()):
                    tail = first.group()
                    if split and split.start(1) < first.end():
                        carry = (start, head + tail, split.group(2))
                        continue
                    compound = f"{head}-{tail}"
                    text.append(" " + (mend(start, compound) if mark == "-" and compound.lower() in own else mend(start, head + tail)))
                    line = line[first.end() :]
                    split = ends_split(line)
                    text.append(TOKEN.sub(lambda m, p=p: mend(p, m.group()), line[: split.start(1)] if split else line))
                    carry = (p, split.group(1), split.group(2)) if split else None
                    continue
                text.append(" " + head + mark)
                carry = None
            body = line[: split.start(1)] if split else line
            text.append(" " + TOKEN.sub(lambda m, p=p: mend(p, m.group()), body))
            carry = (p, split.group(1), split.group(2)) if split else None
        if carry:
            text.append(" " + carry[1] + carry[2])
        out.append(" ".join("".join(text).split()))
    return [t for t in out if t]


TEXT = "chapter_id bigint, paragraphs array<string>, repaired int"


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter of the scanned books as continuous paragraphs, with how many words were repaired."""
    t = lambda name: table(spark, sf_dir, name)
    noise = ScanNoise(t("chapter"), t("edition"), t("book_info"))
    best = small(written(choices(noise), "choices"))
    cases = noise.suspects.withColumn("b", F.coalesce("before", F.lit(""))).join(best.withColumn("b", F.coalesce("before", F.lit(""))).drop("before"), ["part", "b"])
    fixes = cases.groupBy("chapter_id").agg(F.collect_set(F.struct("p_idx", "part", "repair")).alias("fixes"))
    own = noise.rows.filter("kind = 'split'").join(noise.compounds, "compound", "left_semi").groupBy("chapter_id").agg(F.collect_set("compound").alias("own"))
    pages = noise.pages.join(fixes, "chapter_id", "left").join(own, "chapter_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, paragraphs, titles, site, fixed, held in zip(batch["chapter_id"], batch["paragraphs"], batch["titles"], batch["site"], batch["fixes"], batch["own"]):
                repairs = {(f["p_idx"], f["part"]): f["repair"] for f in fixed} if fixed is not None else {}
                rows.append((ident, rebuild(_page(paragraphs, titles, site), repairs, set(held) if held is not None else set()), len(repairs)))
            yield pd.DataFrame(rows, columns=["chapter_id", "paragraphs", "repaired"])

    return pages.mapInPandas(run, TEXT)
