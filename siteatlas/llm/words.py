"""Words of a batch of texts and their hashes, in bulk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = (1 << 64) - 1
BLANKS = bytes([0x20, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, size=256, dtype=np.uint64)
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_of_powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & _M, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (_row_of_powers(b, n) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts laid end to end; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[bounds[0]:bounds[-1]] if buffer else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


class WordBatch:
    """Runs of bytes that are not in ``breaks``.

    ``starts`` and ``ends`` are byte places, ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array, breaks: np.ndarray, fold: np.ndarray | None = None):
        self.data, self.bounds = text_buffer(texts)
        if fold is not None:
            self.data = fold[self.data]
        inside = ~breaks[self.data]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside.copy()
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside.copy()
        edges = self.bounds[(self.bounds > 0) & (self.bounds < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def __len__(self) -> int:
        return len(self.first) - 1

    def hashes(self, first_bytes: int = 0) -> np.ndarray:
        """64-bit hash of each word: sums of byte values times powers of the place, taken back to place 0.

        With ``first_bytes``, of so many bytes of it at most; such hashes differ from those of whole words.
        """
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(self.starts):
            begin = self.starts[at]
            to = max(int(np.searchsorted(self.ends, begin + _PIECE, side="right")), at + 1)
            stop = self.ends[to - 1]
            up, down = _POWERS.get(int(stop - begin) + 1)
            sums = np.zeros(stop - begin + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[begin:stop]] * up[:stop - begin], out=sums[1:], dtype=np.uint64)
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            if first_bytes:
                e = np.minimum(e, s + first_bytes)
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s + (first_bytes << 32)).astype(np.uint64))
            at = to
        return out


def grams(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive words from each place on; places too near to the end get what is there."""
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * salt * 0x9E3779B97F4A7C15) & _M | 1)
    out = np.full(len(hashes), np.uint64(salt + size), dtype=np.uint64)
    for k in range(size):
        out *= base
        out[:max(len(hashes) - k, 0)] += hashes[k:]
    return mix(out)


def table_of(marks: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(marks)] = True
    return out


WHITE = table_of(BLANKS)
