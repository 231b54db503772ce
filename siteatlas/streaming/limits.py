"""Token buckets over a request stream, a busy key cut over many tasks.

What a stretch of a key's requests does to the tokens is a function of the tokens before it, and a small one: between a few limits it
adds a fixed number, or ends at a fixed one.  So a busy key's requests of a micro-batch are cut into chunks in order, every chunk's function
is worked out, the functions of a key, one short row a chunk, are followed from the tokens it had, and each chunk is then decided with
the tokens it really starts from.  A chunk is in one task, and a task goes through its many chunks in one sorted stream of rows, as most
keys have a few requests only.  Between batches a key is two numbers in a table of files.

Tokens are counted in parts of 1 / window_ms, so everything is exact integer arithmetic.  A request whose time is before that of an
earlier one of its key counts as of that time, and so does one without a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.operators import ordered
from siteatlas.streaming import jobs

CHUNK_ROWS = 20_000
# Pieces of a function that are kept as lists; rows that a task sends at once.
SHORT, AT_ONCE = 64, 1000
STATE = "key string, tokens long, at long"


class Flow:
    """Tokens after a stretch of requests as a function of those before: from ``low[i]`` on, ``add[i]`` more, or ``add[i]`` if ``fixed[i]``.

    A few pieces are lists that plain loops go over, which is faster than arrays; many are arrays.
    """

    def __init__(self, full: int, cost: int):
        self.full, self.cost = full, cost
        self.low, self.add, self.fixed = [0], [0], [False]

    def refill(self, amount: int | None) -> None:
        """``amount`` more tokens, full at most; None: full at once."""
        if amount is None:
            self.low, self.add, self.fixed = [0], [self.full], [True]
            return
        if self._short():
            pieces = []
            for low, high, add, fixed in self._pieces():
                where = self.full - add - amount
                if fixed:
                    pieces.append((low, min(self.full, add + amount), True))
                elif low >= where:
                    pieces.append((low, self.full, True))
                else:
                    pieces.append((low, add + amount, False))
                    if where < high:
                        pieces.append((where, self.full, True))
            self._keep(pieces)
            return
        self.add = self.add + amount
        self._cut(self.full)
        # What is above full at the start of a piece is so all over it.
        over = np.where(self.fixed, self.add, self.low + self.add) >= self.full
        self.add, self.fixed = np.where(over, self.full, self.add), self.fixed | over
        self._merge()

    def take(self) -> None:
        """One request: a token goes if there is one."""
        if self._short():
            pieces = []
            for low, high, add, fixed in self._pieces():
                where = self.cost - add
                if fixed:
                    pieces.append((low, add if where > 0 else -where, True))
                elif low >= where:
                    pieces.append((low, -where, False))
                else:
                    pieces.append((low, add, False))
                    if where < high:
                        pieces.append((where, -where, False))
            self._keep(pieces)
            return
        self._cut(self.cost)
        enough = np.where(self.fixed, self.add, self.low + self.add) >= self.cost
        self.add = self.add - np.where(enough, self.cost, 0)
        self._merge()

    def _short(self) -> bool:
        if isinstance(self.low, list) and len(self.low) > SHORT:
            self.low, self.add, self.fixed = np.array(self.low), np.array(self.add), np.array(self.fixed)
        return isinstance(self.low, list)

    def _pieces(self) -> Iterator[tuple[int, int, int, bool]]:
        return zip(self.low, [*self.low[1:], self.full + 1], self.add, self.fixed, strict=True)

    def _keep(self, pieces: list[tuple[int, int, bool]]) -> None:
        """These pieces, neighbours that say the same as one."""
        if len(pieces) > 1:
            pieces = [p for i, p in enumerate(pieces) if not i or p[1:] != pieces[i - 1][1:]]
        self.low, self.add, self.fixed = (list(x) for x in zip(*pieces, strict=True))

    def _cut(self, at: int) -> None:
        """Pieces that pass a number of tokens are cut there."""
        high = np.append(self.low[1:], np.iinfo(np.int64).max)
        where = at - self.add
        split = ~self.fixed & (where > self.low) & (where < high)
        if split.any():
            i = np.flatnonzero(split)
            self.low = np.insert(self.low, i + 1, where[i])
            self.add, self.fixed = np.insert(self.add, i + 1, self.add[i]), np.insert(self.fixed, i + 1, False)

    def _merge(self) -> None:
        if len(self.low) > 1:
            new = np.concatenate([[True], (self.add[1:] != self.add[:-1]) | (self.fixed[1:] != self.fixed[:-1])])
            if not new.all():
                self.low, self.add, self.fixed = self.low[new], self.add[new], self.fixed[new]

    def after(self, tokens: int) -> int:
        i = bisect_right(self.low, tokens) - 1
        return int(self.add[i]) if self.fixed[i] else tokens + int(self.add[i])


class Bucket:
    def __init__(self, most: int, window_ms: int, idle_ms: int):
        self.most, self.idle_ms, self.full, self.cost = most, idle_ms, most * window_ms, window_ms

    def gained(self, gap: int) -> int | None:
        return None if gap > self.idle_ms else gap * self.most

    def refilled(self, tokens: int, gap: int) -> int:
        more = self.gained(gap)
        return self.full if more is None else min(self.full, tokens + more)

    def flow(self, ms: list[int]) -> Flow:
        """Of requests at these times, from the tokens there are when the first one is looked at."""
        flow = Flow(self.full, self.cost)
        flow.take()
        for gap in np.diff(np.maximum.accumulate(ms)).tolist():
            flow.refill(self.gained(gap))
            flow.take()
        return flow

    def decide(self, tokens: int, ms: list[int]) -> tuple[list[bool], list[int]]:
        allowed, left = [], []
        ms = np.maximum.accumulate(ms).tolist()
        for i, now in enumerate(ms):
            if i:
                tokens = self.refilled(tokens, now - ms[i - 1])
            allowed.append(tokens >= self.cost)
            tokens -= self.cost if allowed[-1] else 0
            left.append(tokens // self.cost)
        return allowed, left


# A row is a request, or, before those of its chunk, one without seq that says what the chunk starts from.
ROWS = ["key", "chunk", "seq", "ms", "tokens", "at"]
STARTS = "key string, chunk long, tokens long, at long"
FLOWS = "key string, chunk long, first_ms long, last_ms long, low array<long>, add array<long>, fixed array<boolean>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _in_order(rows: DataFrame, by: list[str], order: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` over the rows of whole groups, each in order, many groups one after another in a task."""
    names, out = rows.columns, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(row for t in batches for row in zip(*(t.column(c).to_pylist() for c in names), strict=True))
        while some := list(islice(found, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    return rows.repartition(*by).sortWithinPartitions(*by, *[F.asc_nulls_first(c) for c in order]).mapInArrow(run, schema)


def _times(floor: int | None, ms: list[int | None]) -> list[int] | None:
    """Times that are not before ``floor``, or before the first known one; None if there is none."""
    known = floor if floor is not None else next((m for m in ms if m is not None), None)
    return None if known is None else [known if m is None else max(known, m) for m in ms]


def _summary(bucket: Bucket):
    """The function of each chunk; its first row says which time its requests are not before."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (key, chunk), members in groupby(rows, itemgetter(0, 1)):
            floor = next(members)[5]
            ms = [m[3] for m in members]
            times = _times(floor, ms)
            flow = bucket.flow(times or [0] * len(ms))
            yield key, chunk, times and times[0], times and max(times), *(
                x if isinstance(x, list) else x.tolist() for x in (flow.low, flow.add, flow.fixed))

    return run


def _stitch(bucket: Bucket):
    """The tokens that each chunk of a key starts from, and, in a row without a chunk, what the key is left with.

    Before the chunks of a key comes a row with what was known of it, if it was.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, members in groupby(rows, itemgetter(0)):
            tokens, at, met = bucket.full, None, False
            for _, chunk, first, last, low, add, fixed, had, since in members:
                if chunk is None:
                    tokens, at = had, since
                    continue
                if at is not None and first is not None:
                    tokens = bucket.refilled(tokens, first - at)
                yield key, chunk, tokens, at if first is None else first
                flow = Flow(bucket.full, bucket.cost)
                flow.low, flow.add, flow.fixed = low, add, fixed
                tokens, at, met = flow.after(tokens), last, True
            if met:
                yield key, None, tokens, at

    return run


def _decisions(bucket: Bucket):
    """Of each chunk's requests; its first row has the tokens it starts from."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, members in groupby(rows, itemgetter(0, 1)):
            tokens, at = next(members)[4:]
            some = list(members)
            times = _times(at, [m[3] for m in some]) or [0] * len(some)
            yield from zip((m[2] for m in some), *bucket.decide(tokens, times), strict=True)

    return run


def _chunks(rows: DataFrame, path: str, chunk_rows: int) -> DataFrame:
    """``key, chunk, seq, ms``: a key of up to ``chunk_rows`` requests is one chunk, a busier one is cut by seq."""
    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows).select("key", F.lit(True).alias("busy"))
    busy.write.mode("overwrite").parquet(path)
    busy = rows.sparkSession.read.schema("key string, busy boolean").parquet(path)
    chunk = F.when(F.col("busy"), ordered.chunk_of("seq", chunk_rows)).otherwise(0).cast("long")
    return rows.join(busy, "key", "left").select("key", chunk.alias("chunk"), "seq", "ms")


def _floors(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``key, chunk, tokens, at`` of each chunk: the tokens are not known yet, ``at`` is the time that its requests are not before, of earlier chunks and batches."""
    latest = rows.groupBy("key", "chunk").agg(F.max("ms").alias("_top"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return latest.join(state.select("key", "at"), "key", "left").select(
        "key", "chunk", F.lit(None).cast("long").alias("tokens"), F.greatest(F.max("_top").over(earlier), F.col("at")).alias("at"))


def milliseconds(time: Column) -> Column:
    return F.floor(F.unix_micros(time) / 1000).cast("long")


def store_rate_limits(requests: DataFrame, path: str, most: int, window_ms: int, idle_ms: int = 600_000, late_ms: int = 600_000,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``seq, allowed, remaining`` of requests with key, seq, event_time, in the order of seq within a micro-batch.

    A key holds ``most`` tokens, refilled within ``window_ms``; one that was idle for longer than ``idle_ms`` is full again, so it is
    dropped once it has been so for ``late_ms``, which is how far behind the newest request one may come.
    """
    spark, bucket = requests.sparkSession, Bucket(most, window_ms, idle_ms)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"),
                            milliseconds(F.col("event_time")).alias("ms")).where("key is not null and seq is not null")
        state = spark.read.schema(STATE).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], STATE)
        rows = _chunks(rows, f"{path}/busy", chunk_rows)
        flows = _in_order(rows.unionByName(_floors(rows, state), True).select(*ROWS), ["key", "chunk"], ["seq", "ms"], _summary(bucket), FLOWS)
        flows.write.mode("overwrite").parquet(f"{path}/flows")
        flows = spark.read.schema(FLOWS).parquet(f"{path}/flows")
        known = state.join(flows.select("key").distinct(), "key", "left_semi")
        starts = _in_order(flows.unionByName(known, True), ["key"], ["chunk"], _stitch(bucket), STARTS)
        starts.write.mode("overwrite").parquet(f"{path}/starts")
        starts = spark.read.schema(STARTS).parquet(f"{path}/starts")
        told = _in_order(rows.unionByName(starts.where("chunk is not null"), True).select(*ROWS), ["key", "chunk"], ["seq", "ms"],
                         _decisions(bucket), "seq long, allowed boolean, remaining long")
        told.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last = starts.where("chunk is null").select("key", "tokens", "at")
        newest = flows.agg(F.max("last_ms").alias("n")).scalar()
        kept = state.join(last, "key", "left_anti").unionByName(last)
        if newest is not None:
            kept = kept.where(F.col("at") >= newest - (idle_ms + late_ms))
        kept.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        jobs.drop_batches(spark, f"{path}/state", number - 1)

    jobs.run_batches(requests, path, write)
    return spark.read.parquet(f"{path}/rows").drop("batch")
