"""Terms of a batch of texts: runs of kept bytes, A-Z folded, numbered within the batch by their spelling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siteatlas.llm.words import WordBatch

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def breaks_but(*kept: tuple[int, int]) -> np.ndarray:
    """ASCII bytes outside the given ranges break terms; bytes of other characters never do."""
    out = np.arange(256) < 0x80
    for low, high in kept:
        out[low:high + 1] = False
    return out


DIGITS, UPPER_CASE, LOWER_CASE = (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)
ALPHANUMERIC = breaks_but(DIGITS, UPPER_CASE, LOWER_CASE)
LETTERS = breaks_but(UPPER_CASE, LOWER_CASE)


class TermBatch:
    """``spelled`` are the batch's distinct terms; ``number`` names them in text order, those of text i at
    ``first[i]:first[i + 1]``.  Terms are told apart by their bytes, not by hashes."""

    def __init__(self, texts: pa.Array, breaks: np.ndarray):
        words = WordBatch(texts, breaks, LOWER)
        sizes = words.ends - words.starts
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        spelled = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(offsets), pa.py_buffer(words.data[~breaks[words.data]]))
        coded = spelled.dictionary_encode()
        self.spelled: pa.Array = coded.dictionary
        self.number: np.ndarray = coded.indices.to_numpy(zero_copy_only=False)
        self.first: np.ndarray = words.first

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def counted(text: np.ndarray, number: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, number, count`` of each term of each text, by text and number; ``text`` must not decrease."""
    key, count = np.unique(text.astype(np.int64) * max(distinct, 1) + number, return_counts=True)
    return key // max(distinct, 1), key % max(distinct, 1), count
