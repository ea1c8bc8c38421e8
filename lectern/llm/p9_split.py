"""Splitting oversized items at natural boundaries.

Method: balanced targets. The least number of pieces that can hold a text is computed, equal
targets are placed, each is snapped to the strongest boundary near it, and where a piece
still breaks the limit a piece is added. Pieces begin ``overlap`` tokens before the cut, at
the nearest word behind; the text without the overlaps is exactly the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokens import TOKENIZERS, VOCABULARY, token_count, token_starts
from lectern.session import table

LIMIT, OVERLAP = 512, 32
#: Strength of the boundary behind white space: before a heading 6, blank line 5, line 4, sentence 3, clause 2, word 1.
HEADING = re.compile(r"#{1,6} |={2,}|(?:Chapitre|Chapter|CHAPITRE|CHAPTER)\b")
SPACES = np.zeros(0x3001, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
SENTENCE_END, CLAUSE_END, CLOSING = ".!?…", ";:,—–", "»”\"'’)]"
#: A cut may lie this share of a piece from its target; within it the strongest boundary wins, the nearest of equals.
SLACK = 0.25


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(offset, strength) of all places where a piece may begin, in order: behind each white space."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = SPACES[np.minimum(cps, 0x3000)] & (cps <= 0x3000)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, at = edge[~space[edge - 1]], edge[space[edge - 1]]
    first = first[: len(at)] if len(first) >= len(at) and (not len(at) or not space[0]) else np.concatenate([[0], first])[: len(at)]
    lines = np.concatenate([[0], np.cumsum(cps == 10)])
    n = lines[at] - lines[first]
    before = cps[np.maximum(first - 1, 0)]
    closing = np.isin(before, [ord(c) for c in CLOSING])
    before = np.where(closing, cps[np.maximum(first - 2, 0)], before)
    strength = np.where(np.isin(before, [ord(c) for c in SENTENCE_END]), 3, np.where(np.isin(before, [ord(c) for c in CLAUSE_END]) & ~closing, 2, 1))
    strength = np.where(n > 1, 5, np.where(n > 0, 4, strength))
    for k in np.flatnonzero(n):
        if HEADING.match(text, int(at[k])):
            strength[k] = 6
    return at, strength


def _cuts(n: int, pieces: int, at: np.ndarray, strength: np.ndarray, most: int) -> list[int]:
    """Token positions of the cuts: equal targets, each snapped within its slack."""
    cuts, low = [], 0
    for k in range(1, pieces):
        size = (n - low) / (pieces - k + 1)
        target = low + size
        slack = size * SLACK
        a, b = np.searchsorted(at, [max(low + 1, target - slack), min(target + slack, low + most, n - 1) + 0.5])
        if b > a:
            near = at[a:b]
            j = np.lexsort((np.abs(near - target), -strength[a:b]))[0]
            low = int(near[j])
        else:
            low = min(int(round(target)), low + most, n - 1)
        cuts.append(low)
    return cuts


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, name: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(start, body, end, tokens) of each piece in characters; body is where the overlap ends.

    A text within the limit is one piece. No piece has more than ``limit`` tokens, counted on
    the piece alone; the overlap is at most ``overlap`` tokens, less only where a word would part.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    starts = token_starts(text, folder, name)
    n = len(starts)
    if n <= limit:
        return [(0, 0, len(text), n)]
    where, strength = boundaries(text)
    # boundaries in tokens: the token that begins at or behind the place
    at = np.searchsorted(starts, where)
    keep = (at > 0) & (at < n)
    at, strength, where = at[keep], strength[keep], where[keep]
    if len(at):
        at, first = np.unique(at, return_index=True)
        strength, where = np.maximum.reduceat(strength, first), where[first]
    spot = dict(zip(at.tolist(), where.tolist()))
    words = where
    body = limit - overlap
    pieces = -(-(n - overlap) // body)
    while True:
        cuts = _cuts(n, pieces, at, strength, body)
        places = [0, *(spot.get(c, int(starts[c])) for c in cuts), len(text)]
        begins, good = [0], True
        for k, (a, b) in enumerate(zip(places, places[1:])):
            start = a
            if k and overlap:
                wanted = int(starts[max(0, int(np.searchsorted(starts, a)) - overlap)])
                j = int(np.searchsorted(words, wanted))
                start = int(words[j]) if j < len(words) and words[j] < a else wanted
                while start < a and token_count(text[start:a], folder, name) > overlap:
                    j += 1
                    start = min(int(words[j]) if j < len(words) else a, a)
                start = max(start, places[k - 1])
            if k:
                begins.append(start)
            # spans of the whole text's tokens: off by a token or two at either end
            if b <= a or np.searchsorted(starts, b) - np.searchsorted(starts, start) > limit + 3:
                good = False
                break
        if good:
            sizes = [token_count(text[start:b], folder, name) for start, b in zip(begins, places[1:])]
            if max(sizes) <= limit:
                return list(zip(begins, places, places[1:], sizes))
        pieces += 1


PIECES = "doc_id bigint, piece int, pieces int, start bigint, body bigint, end bigint, n_tokens int, text string"


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Every document over ``limit`` tokens as pieces; start, body and end are character offsets.

    NULL texts, empty ones and those within the limit give no rows. Every row of ``documents``
    is split, repeated ones as often as they stand; no row leaves its partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for ident, text in zip(batch["doc_id"], batch["text"]):
                parts = split_text(text, limit, overlap, folder, name)
                if len(parts) > 1:
                    rows.extend((ident, k, len(parts), a, b, e, n, text[a:e]) for k, (a, b, e, n) in enumerate(parts))
            yield pd.DataFrame(rows, columns=names)

    # a text of fewer bytes than the limit can't have more tokens than that
    return documents.select("doc_id", "text").filter(F.octet_length("text") > limit).mapInPandas(run, PIECES)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document over the limit."""
    return split_documents(table(spark, sf_dir, "documents"))
