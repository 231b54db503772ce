"""Near-duplicate decisions of all titles in a number of rounds that does not follow the length of a chain of pages.

The rule is sequential: a page is kept if no earlier kept page has its structure or scores high enough against it.  Pages of one title
lie on a grid of link and form counts and only meet within ``reach`` of each other there.  A round cuts the undecided points of a
title into blocks of neighbouring link counts, of bounded size, and decides each block's points in order, in one task, knowing the
undecided points around the block but not what becomes of them.

* A point whose earlier rivals are all decided is decided.
* A point that depends on one unknown point h outside its block, through whatever chain inside, is noted as "as h" or "not h".  Such
  notes are followed by pointer jumping: every step halves the chain of blocks that is left.
* What hangs on several unknown points waits for the next round, whose blocks are cut elsewhere.

The earliest undecided point of a title is always decided, so rounds end; a chain of n blocks takes one round of about log2(n) steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.operators import ordered
from siteatlas.session import cut_lineage, forget

POINT = ["title", "links", "forms", "length", "seq"]
# Undecided points of a block; the points within reach around it come on top.
BLOCK_POINTS = 20_000
# What is known of a point: nothing yet, kept, dropped, or that it goes with or against another one.
OPEN, KEPT, DROPPED, TIED = 0, 1, 2, 3
_OWN, _AROUND, _SETTLED = 0, 1, 2


class _Block:
    """The sequential rule over one block, with unknown neighbours.

    ``live`` holds, by grid cell, the points so far that are kept or may be: (links, forms, length, tie), a tie being None for a kept
    point, (seq, as) for one that is decided as, or against, the point of that number, and False for one of which no more is known.
    """

    def __init__(self, reach: int, threshold: float):
        self.step, self.reach, self.threshold = reach + 1, reach, threshold
        self.live: dict[tuple[int, int], list] = {}
        self.kept: set[tuple[int, int]] = set()

    def _similar(self, a, b) -> bool:
        apart = abs(a[0] - b[0]) + abs(a[1] - b[1])
        if apart > self.reach:
            return False
        longest = max(a[2], b[2])
        ratio = 1.0 - min(abs(a[2] - b[2]) / longest, 1.0) if longest > 0 else 1.0
        return 0.4 + (1.0 - min(apart, 20) / 20.0) * 0.3 + ratio * 0.3 >= self.threshold

    def take(self, point: tuple[int, int, int], seq: int, kind: int) -> tuple[int, int | None, bool | None]:
        """(status, seq of the point it is tied to, whether it goes with it) of the next point."""
        shape, cell = point[:2], (point[0] // self.step, point[1] // self.step)
        if kind == _SETTLED:
            self.kept.add(shape)
            self.live.setdefault(cell, []).append((*point, None))
            return KEPT, None, None
        if shape in self.kept:
            return DROPPED, None, None
        ties = []
        for across in (-1, 0, 1):
            for along in (-1, 0, 1):
                for other in self.live.get((cell[0] + across, cell[1] + along), ()):
                    if other[:2] == shape or self._similar(point, other):
                        if other[3] is None:
                            return DROPPED, None, None
                        ties.append(other[3])
        known = {t for t in ties if t}
        if any((s, not way) in known for s, way in known):
            return DROPPED, None, None  # one of two rivals is kept, whichever
        if kind == _AROUND:
            status, tie = TIED, (seq, True)
        elif not ties:
            status, tie = KEPT, None
            self.kept.add(shape)
        elif len(known) == 1 and all(ties):
            (root, way), = known
            status, tie = TIED, (root, not way)
        else:
            status, tie = OPEN, False
        self.live.setdefault(cell, []).append((*point, tie))
        return (status, *tie) if tie else (status, None, None)


def _solver(reach: int, threshold: float):
    names = [*POINT, "status", "root", "way"]
    schema = pa.schema([pa.field("title", pa.string()), *[pa.field(c, pa.int64()) for c in POINT[1:]],
                        pa.field("status", pa.int32()), pa.field("root", pa.int64()), pa.field("way", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            out = []
            for title, number, links, forms, length, seq, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (title, number):
                    now, block = (title, number), _Block(reach, threshold)
                told = block.take((links, forms, length), seq, kind)
                if kind == _OWN:
                    out.append((title, links, forms, length, seq, *told))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=names)

    return run


def _routed(points: DataFrame, kept: DataFrame, reach: int, size: int, shift: int) -> DataFrame:
    """Rows of each block: its own points, those around it, and the kept ones among all these."""
    columns = points.groupBy("title", "links").agg(F.count(F.lit(1)).alias("n"))
    upto = ordered.running_totals(columns, ["title"], [ordered.chunk_of("links", 1000)], ["links"], {"upto": F.col("n")})
    own = cut_lineage(upto.select("title", "links", F.floor((F.col("upto") - F.col("n") + shift) / size).cast("long").alias("own")), "near-columns")
    near = F.explode(F.sequence(F.col("links") - reach, F.col("links") + reach)).alias("links")
    routes = own.select("title", F.col("own").alias("block"), near).distinct()
    mine = points.join(own, ["title", "links"]).join(routes, ["title", "links"]).select(
        "title", "block", *POINT[1:], F.when(F.col("block") == F.col("own"), _OWN).otherwise(_AROUND).alias("kind"))
    settled = kept.join(routes, ["title", "links"]).select("title", "block", *POINT[1:], F.lit(_SETTLED).alias("kind"))
    return mine.unionByName(settled)


def _followed(told: DataFrame) -> DataFrame:
    """Ties followed to their ends: decided where the end is, OPEN where it is not; ``told`` holds every undecided point once."""
    ties = cut_lineage(told.where(F.col("status") == TIED).select("seq", "root", "way"), "near-ties")
    ends = told.where(F.col("status") != TIED).select(F.col("seq").alias("root"), "status")
    while True:
        onward = ties.select(F.col("seq").alias("root"), F.col("root").alias("_root"), F.col("way").alias("_way"))
        step = ties.join(onward, "root", "left")
        step = step.select("seq", F.coalesce("_root", "root").alias("root"), (F.col("way") == F.coalesce("_way", F.lit(True))).alias("way"),
                           F.col("_root").isNotNull().alias("moved"))
        before, ties = ties, cut_lineage(step, "near-ties")
        forget(before)
        if ties.where("moved").isEmpty():
            break
    end = F.when(F.col("status") == OPEN, OPEN).when((F.col("status") == KEPT) == F.col("way"), KEPT).otherwise(DROPPED)
    found = ties.join(ends, "root").select("seq", end.alias("_end"))
    joined = told.join(found, "seq", "left")
    return joined.select(*POINT, F.when(F.col("status") == TIED, F.coalesce("_end", F.lit(OPEN))).otherwise(F.col("status")).alias("status"))


def settle(points: DataFrame, threshold: float, reach: int, block_points: int | None = None,
           settled: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The kept ones of ``points`` (title, links, forms, length, seq; a seq each) and the number of rounds it took.

    ``settled`` are pages that are kept already, by smaller seqs; they are among the result.
    """
    size = block_points or BLOCK_POINTS
    left = cut_lineage(points.select("title", *[F.col(c).cast("long") for c in POINT[1:]]), "near-open")
    kept = left.limit(0) if settled is None else settled.select("title", *[F.col(c).cast("long") for c in POINT[1:]])
    for number in count(1):
        routed = _routed(left, kept, reach, size, size // 2 if number % 2 == 0 else 0)
        sorted_ = routed.repartition("title", "block").sortWithinPartitions("title", "block", "seq")
        told = cut_lineage(sorted_.mapInArrow(_solver(reach, threshold), "title string, links long, forms long, length long, seq long, "
                                              "status int, root long, way boolean"), "near-told")
        row = told.agg(F.count_if(F.col("status") == TIED).alias("tied"), F.count_if(F.col("status") == OPEN).alias("open")).first()
        if row["tied"]:
            followed = cut_lineage(_followed(told), "near-followed")
            forget(told)
            told, waits = followed, not followed.where(F.col("status") == OPEN).isEmpty()
        else:
            waits = row["open"] > 0
        kept = kept.unionByName(told.where(F.col("status") == KEPT).select(*POINT))
        forget(left)
        if not waits:
            return cut_lineage(kept, "near-kept"), number
        if number % 8 == 0:
            kept = cut_lineage(kept, "near-kept")
        left = cut_lineage(told.where(F.col("status") == OPEN).select(*POINT), "near-open")
