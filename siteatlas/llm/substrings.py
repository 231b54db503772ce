"""Repeated word windows across documents, found by fixed-block anchors.

Reference blocks are the non-overlapping blocks of ``block`` words of every document.  A window of ``window`` >= 2 * block - 1
words holds a whole block wherever it lies, so a window that repeats an earlier one meets that one's block with one of its own
rolling windows of ``block`` words.  Four steps follow:

1. Each chunk of documents sends its rolling windows' hashes, and which of them are blocks, to hash buckets (a key once a chunk).
2. Each bucket tells the chunks which hashes are blocks that occur at two places or more: the anchors.
3. Anchors are extended to both sides: the windows of ``window`` words around one are sent to buckets, each key once a chunk, with its
   first place.  A bucket tells every chunk but that of the first place that the window starts earlier elsewhere.
4. The union of all such windows, and of those that start earlier in the same chunk, is what a maximal repeat covers; it goes.

Chunks and buckets travel as packed rows (sorted hashes as byte planes of their differences), not as a row for each word.  A key that
a third of all documents share is one entry for each chunk.  The texts are shuffled once and that shuffle is used three times.
A hash of the first step has 32 bits besides the bucket's: a false anchor only costs a lookup.  A window is identified by 64 bits
besides the bucket's, which are taken from a second hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import identified, shuffle_width, text_bytes
from siteatlas.llm.words import WHITE, WordBatch, grams

# Text bytes of a chunk, and of the text behind one bucket: what one Python task holds at a time.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
_NULL_ID = np.iinfo(np.int64).min


def planes(values: np.ndarray) -> bytes:
    """Non-decreasing values as byte planes of their differences: high planes are nearly empty and compress away."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, n: int, dtype) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(-1, n).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


class Chunk:
    """Documents of a chunk in the order (doc_id, mark); copies of one stored row are one document."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.num_rows
        ids = pc.fill_null(rows.column("doc_id"), int(_NULL_ID)).to_numpy()
        marks = rows.column("mark").to_numpy()
        order = np.lexsort((marks, ids))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
        self.document = np.empty(len(order), dtype=np.int64)  # of each row
        self.document[order] = np.cumsum(new) - 1
        self.ids = ids[order][new]
        self.texts = pa.concat_arrays(rows.column("text").take(pa.array(order[new])).cast(pa.large_string()).chunks or [pa.array([], pa.large_string())])
        self.words = WordBatch(self.texts, WHITE)
        self.hashes = self.words.hashes()
        first = self.words.first
        sizes = np.diff(first)
        self.start = np.repeat(first[:-1], sizes)     # of each word's document
        self.room = np.repeat(first[1:], sizes) - np.arange(len(self.hashes))

    def places(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.room >= size)

    def probes(self, size: int, buckets: int) -> tuple[np.ndarray, ...]:
        """(bucket and hash of each distinct rolling window, its number at every place, the places)."""
        at = self.places(size)
        g = grams(self.hashes, size)[at]
        key = ((g >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (g & np.uint64(0xFFFFFFFF))
        distinct, number = np.unique(key, return_inverse=True)
        return distinct, number, at


def _send_probes(rows: pa.Table, chunk: int, size: int, buckets: int) -> pa.Table:
    c = Chunk(rows)
    distinct, number, at = c.probes(size, buckets)
    block = np.zeros(len(distinct), dtype=bool)
    block[number[(at - c.start[at]) % size == 0]] = True
    twice = np.bincount(number, minlength=len(distinct)) > 1
    bucket = (distinct >> np.uint64(32)).astype(np.int64)
    present, begin = np.unique(bucket, return_index=True)
    end = np.append(begin, len(distinct))[1:]
    low = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({
        "bucket": pa.array(present, pa.int32()), "chunk": pa.array(np.full(len(present), chunk), pa.int32()),
        "n": pa.array(end - begin, pa.int32()),
        "keys": pa.array([planes(low[b:e]) for b, e in zip(begin, end, strict=True)], pa.binary()),
        "flags": pa.array([np.packbits(block[b:e]).tobytes() + np.packbits(twice[b:e]).tobytes() for b, e in zip(begin, end, strict=True)], pa.binary())})


def _find_anchors(rows: pa.Table) -> pa.Table:
    keys, block, count, sizes = [], [], [], rows.column("n").to_pylist()
    for n, raw, flags in zip(sizes, rows.column("keys").to_pylist(), rows.column("flags").to_pylist(), strict=True):
        half = len(flags) // 2
        keys.append(from_planes(raw, n, np.uint32))
        block.append(np.unpackbits(np.frombuffer(flags[:half], dtype=np.uint8), count=n).astype(bool))
        count.append(1 + np.unpackbits(np.frombuffer(flags[half:], dtype=np.uint8), count=n).astype(np.int64))
    key, number = np.unique(np.concatenate(keys), return_inverse=True)
    anchor = np.bincount(number, weights=np.concatenate(count), minlength=len(key)) > 1
    some = np.zeros(len(key), dtype=bool)
    some[number[np.concatenate(block)]] = True
    hit = (anchor & some)[number]
    out, at = [], 0
    for chunk, n in zip(rows.column("chunk").to_pylist(), sizes, strict=True):
        if hit[at:at + n].any():
            out.append((chunk, np.packbits(hit[at:at + n]).tobytes()))
        at += n
    bucket = rows.column("bucket")[0].as_py()
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                     "hits": pa.array([h for _, h in out], pa.binary())})


def _send_windows(rows: pa.Table, answers: pa.Table, chunk: int, block: int, window: int, buckets: int) -> pa.Table:
    c = Chunk(rows)
    distinct, number, at = c.probes(block, buckets)
    hit = np.zeros(len(distinct), dtype=bool)
    bounds = np.searchsorted(distinct >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column("hits").to_pylist(), strict=True):
        b, e = bounds[bucket], bounds[bucket + 1]
        hit[b:e] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=e - b).astype(bool)
    anchors = np.zeros(len(c.hashes) + 1, dtype=np.int64)
    anchors[at[hit[number]] + 1] = 1
    anchors = np.cumsum(anchors)
    starts = c.places(window)
    starts = starts[anchors[starts + window - block + 1] > anchors[starts]]
    key = grams(c.hashes, window, 1)[starts]
    bucket = ((grams(c.hashes, window, 2)[starts] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    _, first = np.unique(key, return_index=True)  # the first place of each window in the chunk
    first = first[np.lexsort((first, bucket[first]))]
    present, begin = np.unique(bucket[first], return_index=True)
    end = np.append(begin, len(first))[1:]
    places = starts[first].astype(np.uint32)
    ids = c.ids[np.searchsorted(c.words.first, places, side="right") - 1]
    return pa.table({
        "bucket": pa.array(present, pa.int32()), "chunk": pa.array(np.full(len(present), chunk), pa.int32()),
        "n": pa.array(end - begin, pa.int32()),
        "keys": pa.array([key[first[b:e]].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()),
        "places": pa.array([planes(places[b:e]) for b, e in zip(begin, end, strict=True)], pa.binary()),
        "ids": pa.array([planes(ids[b:e]) for b, e in zip(begin, end, strict=True)], pa.binary())})


def _find_firsts(rows: pa.Table) -> pa.Table:
    """For every chunk the places whose window starts earlier in another chunk."""
    sizes = rows.column("n").to_pylist()
    key = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in rows.column("keys").to_pylist()])
    place = np.concatenate([from_planes(p, n, np.uint32) for p, n in zip(rows.column("places").to_pylist(), sizes, strict=True)])
    ids = np.concatenate([from_planes(p, n, np.int64) for p, n in zip(rows.column("ids").to_pylist(), sizes, strict=True)])
    chunk = np.repeat(rows.column("chunk").to_numpy(), sizes)
    order = np.lexsort((chunk, ids, key))
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    out = []
    for number in np.unique(chunk[later]):
        out.append((number, np.sort(place[later & (chunk == number)])))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "n": pa.array([len(p) for _, p in out], pa.int32()),
                     "places": pa.array([planes(p) for _, p in out], pa.binary())})


def _cut(rows: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    c = Chunk(rows)
    starts = c.places(window)
    _, first = np.unique(grams(c.hashes, window, 1)[starts], return_index=True)
    later = np.ones(len(starts), dtype=bool)
    later[first] = False
    edge = np.bincount(starts[later], minlength=len(c.hashes) + 1).astype(np.int64)
    for n, raw in zip(answers.column("n").to_pylist(), answers.column("places").to_pylist(), strict=True):
        edge[from_planes(raw, n, np.uint32)] += 1
    edge[window:] -= edge[:-window].copy() if len(edge) > window else 0
    gone = np.cumsum(edge[:-1]) > 0
    texts, n_words, n_gone = [], np.diff(c.words.first), []
    for i, text in enumerate(c.texts.to_pylist()):
        own = gone[c.words.first[i]:c.words.first[i + 1]]
        words = text.encode("utf-8", "surrogatepass").split()
        n_gone.append(int(own.sum()))
        if n_gone[-1]:
            words = [words[k] for k in np.flatnonzero(~own)]
        texts.append(b" ".join(words))
    pick = c.document
    return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words[pick], pa.int64()),
                     "n_removed": pa.array(np.array(n_gone, dtype=np.int64)[pick], pa.int64()),
                     "text": pa.array([texts[k] for k in pick], pa.binary()).cast(pa.string())})


def remove(docs: DataFrame, window: int = 20, block: int = 10) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of every row; ``text`` holds the kept words, joined by one space.

    A word goes if a window that covers it also starts earlier: in a document of smaller id, or before in its own.  Windows are judged
    on the input.  Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.

    Null or empty text, or no words: zero words, empty text.  Texts shorter than a window lose nothing.  Repeated rows (same id and
    text) are one document, and all of them stay alike.  Rows that share only their id, and rows without one (they come first),
    are ordered by a hash.  Empty table: no rows.  Other columns are left alone.
    """
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("block must be from 1 to (window + 1) / 2")
    size, width = text_bytes(docs), shuffle_width(docs.sparkSession)
    chunks, buckets = (max(2 * width, size // b + 1) for b in (CHUNK_BYTES, BUCKET_BYTES))
    keyed = identified(docs).withColumn("mark", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("chunk", F.pmod(F.col("mark"), F.lit(chunks)).cast("int"))
    of_chunk = keyed.groupBy("chunk")

    def number(key) -> int:
        return key[0].as_py()

    probes = of_chunk.applyInArrow(lambda key, t: _send_probes(t, number(key), block, buckets),
                                   "bucket int, chunk int, n int, keys binary, flags binary")
    anchors = probes.groupBy("bucket").applyInArrow(_find_anchors, "chunk int, bucket int, hits binary")
    windows = of_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(
        lambda key, t, a: _send_windows(t, a, number(key), block, window, buckets),
        "bucket int, chunk int, n int, keys binary, places binary, ids binary")
    firsts = windows.groupBy("bucket").applyInArrow(_find_firsts, "chunk int, n int, places binary")
    return of_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(
        lambda key, t, a: _cut(t, a, window), "doc_id long, n_words long, n_removed long, text string")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
