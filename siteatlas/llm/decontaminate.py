"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are the items' windows of ``window`` consecutive words (a shorter item is one pattern of its own length);
one searcher holds all patterns of one length.  A block is two words.  The shift table says how far the search may move
when a block ends at the current word: as far as the block's last place in any pattern is from the pattern's end, and past
it where no pattern holds the block.  At shift 0 the bucket of patterns that end in the block is looked up, and direct
comparison of all words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import identified, unpacked, whole_row

# Words are runs of bytes other than ASCII marks and blanks; A-Z count as a-z.  Bytes of 0x80 and above are word bytes.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Searcher:
    """All patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets.setdefault(self._key(pattern, length), {})[pattern] = owners

    def _key(self, text, end: int):
        return (text[end - 2], text[end - 1]) if self.block == 2 else text[end - 1]

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, owners) of every occurrence, also overlapping ones."""
        m, n, shift, buckets = self.m, len(text), self.shift.get, self.buckets
        far = m - self.block + 1
        end = m
        if self.block == 2:
            while end <= n:
                step = shift((text[end - 2], text[end - 1]), far)
                if step:
                    end += step
                    continue
                owners = buckets[text[end - 2], text[end - 1]].get(tuple(text[end - m:end]))
                if owners:
                    yield end - m, owners
                end += 1
        else:
            for i, word in enumerate(text):
                if word in buckets:
                    yield i, buckets[word][(word,)]


def searchers(items: list[tuple], window: int) -> list[Searcher]:
    """``items``: (id, text)."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        found = words(text or "")
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(found[i:i + size]), set()).add(item)
    return [Searcher(size, patterns) for size, patterns in sorted(by_length.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The query set in blocks of at most about ``block_bytes`` of text, one at a time."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        n = len((text or "").encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


HITS = "array<struct<first:long,last:long>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20,
           query_set_bytes: int = 128 << 20) -> DataFrame:
    """One row for each document row: ``doc_id, n_words, hits, items``.

    ``hits`` are the spans ``{first, last}`` of covered words (merged, in order), ``items`` the sorted ids (as text) of
    the items with a window in the document.  The query set is broadcast in blocks of ``block_bytes``; documents pass
    through one searcher after another without a shuffle.  A set above ``query_set_bytes`` is refused: it is no
    benchmark any more, and belongs in a join.

    Null or empty text: no words, no hits.  Items without words have no windows; items with a null id cover words but
    are not listed; equal items count each.  Repeated document rows and ids: a row each; null ids stay null.  Empty
    tables: no rows, or rows without hits.  Other columns of either table are left alone.
    """
    return _searched(identified(docs), benchmark, window, block_bytes, query_set_bytes).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20,
          query_set_bytes: int = 128 << 20) -> DataFrame:
    """The documents without a window of the benchmark, all columns as they are; cases as in ``search``."""
    rows = docs.select(whole_row(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = _searched(rows, benchmark, window, block_bytes, query_set_bytes)
    return found.where(F.size("hits") == 0).select(*unpacked(docs.columns))


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, query_set_bytes: int) -> DataFrame:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > query_set_bytes:
        raise ValueError(f"the query set holds {size} bytes, more than {query_set_bytes}")
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(HITS),
                            "items": F.array().cast("array<string>")})
    schema = out.schema
    for block in item_blocks(benchmark, block_bytes):
        out = out.mapInArrow(_search_block(rows.sparkSession.sparkContext.broadcast(block), window), schema)
    return out


def _search_block(block, window: int):
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = searchers(block.value, window)
        for batch in batches:
            counts = []
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = words(text)
                counts.append(len(found))
                covered = [(s["first"], s["last"]) for s in hits[i]]
                owners = set()
                for tool in tools:
                    for at, who in tool.find(found):
                        covered.append((at, at + tool.m - 1))
                        owners |= who
                hits[i] = merged(covered)
                items[i] = sorted({*items[i], *(str(o) for o in owners if o is not None)})
            new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, spans), "items": pa.array(items, pa.list_(pa.string()))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans that overlap or touch become one."""
    if not spans:
        return []
    spans.sort()
    first = np.array([s[0] for s in spans])
    last = np.fromiter(accumulate((s[1] for s in spans), max), dtype=np.int64, count=len(spans))
    starts = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + 1]))
    ends = np.concatenate([starts[1:], [len(spans)]]) - 1
    return [{"first": int(first[a]), "last": int(last[b])} for a, b in zip(starts, ends, strict=True)]


def digest(found: DataFrame) -> DataFrame:
    """Counts and a checksum of what ``search`` found."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))
