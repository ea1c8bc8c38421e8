"""Token counts and offsets under a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Folder of the vocabulary files and the file that counts; both are parameters of every operator.
TOKENIZERS, VOCABULARY = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: Texts are cut before letters at this length for encoding only, so that no run of one sign costs quadratic time.
LONG = 100_000


@functools.cache
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """(encoder, byte length of each id) of a rank file of a byte-level BPE."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the published split pattern of this vocabulary.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def _parts(text: str) -> list[str]:
    if len(text) <= LONG:
        return [text]
    cuts = [0]
    while len(text) - cuts[-1] > LONG:
        end = cuts[-1] + LONG
        space = text.rfind(" ", cuts[-1] + LONG // 2, end)
        cuts.append(space if space > 0 else end)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def token_count(text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> int:
    encoder, _ = encoding(folder, name)
    return sum(len(encoder.encode_ordinary(p)) for p in _parts(text))


def token_starts(text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> np.ndarray:
    """Character offset where each token begins (a token inside a character begins with it)."""
    encoder, lengths = encoding(folder, name)
    ids = np.array([t for p in _parts(text) for t in encoder.encode_ordinary(p)], dtype=np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    data = text.encode("utf-8", "surrogatepass")
    if len(data) == len(text):
        return starts
    char = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
    return char[starts] if len(starts) else starts
