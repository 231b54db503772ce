"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C / (k + 1), C / k], and a sequence of class k
takes exactly k pieces.  A task needs nothing but its own rows for that, so tasks pack independently and no row is
shuffled.  A document is first cut at multiples of C; what is left is kept whole where it nearly fills its class, else
it gives a piece that fills the next class exactly and goes on with the rest.  When a task ends, the sequences of
classes that did not fill up are dissolved: their pieces are laid end to end, cut into full sequences, and the last part
into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siteatlas.llm.common import identified
from siteatlas.llm.encoding import encoder

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "ids_crc32 long, padding long, ids binary")


def cut(length: int, capacity: int, slack: int = 64) -> list[int]:
    """Piece lengths of one document.

    A last piece stays whole if its class is not more than 1/slack of its length larger; any other is cut once more, to
    a length that fills a class exactly.
    """
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= rest // slack or rest <= slack:
            pieces.append(rest)
            break
        piece = capacity // (k + 1)
        pieces.append(piece)
        rest -= piece
    return pieces


class Packer:
    """Sequences of one task: each call gives back the pieces of the sequences that it filled."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple], size: int) -> list[tuple]:
        offset, done = 0, []
        for doc_id, start, total, ids in pieces:
            done.append((doc_id, start, total, ids, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return [(*piece, size - offset) if i == len(done) - 1 else (*piece, 0) for i, piece in enumerate(done)]

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for n in cut(len(ids), self.capacity):
            k = self.capacity // n
            mates = self.open.setdefault(k, [])
            mates.append((doc_id, start, len(ids), ids[start:start + n].copy()))
            start += n
            if len(mates) == k:
                yield from self._close(self.open.pop(k), self.capacity)

    def finish(self) -> Iterator[tuple]:
        """The rest, end to end: at most a sequence's worth of pieces for each class is left."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(p[3]) for p in rest)
        room = self._size(left)
        mates, used = [], 0
        for doc_id, start, total, ids in rest:
            while len(ids):
                part = ids[:room - used]
                mates.append((doc_id, start, total, part))
                start, ids, used = start + len(part), ids[len(part):], used + len(part)
                if used == room:
                    yield from self._close(mates, room)
                    left -= used
                    mates, used, room = [], 0, self._size(left)

    def _size(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, padding, ids``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left alone.  A document is its ids and ``end_id``.
    ``start`` counts ids of the document before the piece, ``offset`` ids of the sequence before it; ``ids`` are
    little-endian unsigned 32-bit integers; ``padding`` stands on a sequence's last piece and is 0 elsewhere.

    Null or empty text: one piece of one id.  Repeated rows and ids: each row is packed by itself; null ids stay null.
    Very long text: cut at multiples of the capacity.  Equal lengths keep the order of the rows.  Empty table: no rows.
    ``capacity`` is a power of two.  Sequence numbers are unique: the task's number in the upper bits.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bulk, packer = encoder(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 36)

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            pieces = list(pieces)
            for i in range(0, len(pieces), 5000):
                some = pieces[i:i + 5000]
                raw = [p[3].astype("<u4", copy=False).tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64()),
                    pa.array([len(p[3]) for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()), pa.array([p[5] for p in some], pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([p[6] for p in some], pa.int64()),
                    pa.array(raw, pa.binary())], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            ids, bounds = bulk.encode(batch.column(1))
            end, done = np.array([end_id], dtype=np.uint32), []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                done.extend(packer.add(doc_id, np.concatenate([ids[bounds[i]:bounds[i + 1]], end])))
            yield from rows(done)
        yield from rows(packer.finish())

    return identified(docs).mapInArrow(run, SCHEMA)
