"""First sightings of URLs in a stream, without a time window.

Every URL ever seen is in a table on disk, dealt into buckets by its hash, and each bucket has Bloom filters over its keys.  A
micro-batch is reduced to its distinct URLs; those that no filter of their bucket knows are new, and only for the others, few unless
the batch repeats old URLs, the buckets' rows are read.  Nothing is forgotten and no row is too late; state is files, not memory.

A bucket's filters are layers: when the newest holds as many keys as it is made for, the next one is made twice as large.  A batch
writes its own folders, over themselves when it is retried, and reads those of earlier batches only; before every ``merge_every``-th
batch what is there is merged and what that replaces is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.session import cut_lineage, forget
from siteatlas.streaming import jobs

BUCKETS = 256
# Keys that the first filter of a bucket is made for, bits a key and probes: one false answer in a hundred.
FIRST_KEYS, BITS, PROBES = 4096, 10, 7
# Layers beyond this one are as large as it is, 42 MB; a table with many such wants more buckets.
DOUBLED = 13
FILTERS = "bucket int, layer int, n long, bits binary"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Bit places (keys x probes) by double hashing."""
    step = h2.astype(np.uint64) | np.uint64(1)
    return ((h1.astype(np.uint64)[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def known_to(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold."""
    at = _places(h1, h2, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def add_to(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
    at = _places(h1, h2, len(bits) * 8).ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _room(layer: int) -> int:
    return FIRST_KEYS << min(layer, DOUBLED)


def _asked(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of one bucket with ``maybe``: whether one of its filters knows them."""
    h1, h2 = (keys.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    maybe = np.zeros(keys.num_rows, dtype=bool)
    for raw in filters.column("bits").to_pylist():
        maybe |= known_to(np.frombuffer(raw, dtype=np.uint8), h1, h2)
    return keys.append_column("maybe", pa.array(maybe))


def _grown(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The filters of one bucket that change when new keys come in: the newest layer, and the next ones if it is full."""
    h1, h2 = (keys.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    bucket = keys.column("bucket")[0].as_py() if keys.num_rows else 0
    rows = sorted(filters.to_pylist(), key=lambda r: r["layer"])
    layer, n = (rows[-1]["layer"], rows[-1]["n"]) if rows else (0, 0)
    bits = np.frombuffer(rows[-1]["bits"], dtype=np.uint8).copy() if rows else np.zeros(_room(0) * BITS // 8, dtype=np.uint8)
    out, at = [], 0
    while at < len(h1):
        if n >= _room(layer):
            if out and out[-1]["layer"] == layer:
                out[-1]["bits"], out[-1]["n"] = bits.tobytes(), n
            layer, n = layer + 1, 0
            bits = np.zeros(_room(layer) * BITS // 8, dtype=np.uint8)
        take = min(len(h1) - at, _room(layer) - n)
        add_to(bits, h1[at:at + take], h2[at:at + take])
        at, n = at + take, n + take
        if not out or out[-1]["layer"] != layer:
            out.append({"bucket": bucket, "layer": layer})
        out[-1]["bits"], out[-1]["n"] = bits.tobytes(), n
    return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("layer", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]))


def _by_bucket(rows: DataFrame, path: str) -> None:
    """Files hold whole buckets, in order, so a read for some buckets skips files and row groups; a small batch is one file."""
    rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(path)


class SeenTable:
    """Keys seen by earlier batches of a stream: ``path``/keys and ``path``/filters, by batch and bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_every: int = 10):
        self.spark, self.path, self.buckets, self.merge_every = spark, path, buckets, merge_every

    def filters(self, number: int, merging: bool = False) -> DataFrame:
        rows = jobs.earlier(self.spark, f"{self.path}/filters", FILTERS, number, merging)
        newest = rows.groupBy("bucket", "layer").agg(F.max_by(F.struct("n", "bits"), "batch").alias("f"))
        return newest.select("bucket", "layer", "f.n", "f.bits")

    def keys(self, number: int, merging: bool = False) -> DataFrame:
        return jobs.earlier(self.spark, f"{self.path}/keys", "normalized string, bucket int", number, merging)

    def unseen(self, keys: DataFrame, number: int) -> DataFrame:
        """The distinct ``normalized`` of ``keys`` that no earlier batch had, with bucket and hashes."""
        key = F.col("normalized")
        named = keys.select("normalized").distinct().select(
            "normalized", bucket_of(key, self.buckets).alias("bucket"), F.xxhash64(key, F.lit(1)).alias("h1"), F.xxhash64(key, F.lit(2)).alias("h2"))
        asked = named.groupBy("bucket").cogroup(self.filters(number).groupBy("bucket")).applyInArrow(
            _asked, "normalized string, bucket int, h1 long, h2 long, maybe boolean")
        asked = cut_lineage(asked, "seen-asked")
        hit = [r["bucket"] for r in asked.where("maybe").select("bucket").distinct().collect()]  # as many as there are buckets, at most
        maybe = asked.where("maybe")
        if hit:
            known = self.keys(number).where(F.col("bucket").isin(hit)).select("bucket", "normalized")
            maybe = maybe.join(known, ["bucket", "normalized"], "left_anti")
        fresh = cut_lineage(asked.where("not maybe").unionByName(maybe).drop("maybe"), "seen-fresh")
        forget(asked)
        return fresh

    def add(self, fresh: DataFrame, number: int) -> None:
        _by_bucket(fresh.select("normalized", "bucket"), f"{self.path}/keys/kind=update/batch={number}")
        grown = fresh.groupBy("bucket").cogroup(self.filters(number).groupBy("bucket")).applyInArrow(_grown, FILTERS)
        grown.write.mode("overwrite").parquet(f"{self.path}/filters/kind=update/batch={number}")

    def merge(self, number: int) -> None:
        """At the start of a batch: see ``jobs.merge_batches``."""
        def merge_keys(target: str) -> None:
            _by_bucket(self.keys(number, merging=True).select("normalized", "bucket").distinct(), target)

        jobs.merge_batches(self.spark, f"{self.path}/keys", number, self.merge_every, merge_keys)
        jobs.merge_batches(self.spark, f"{self.path}/filters", number, self.merge_every,
                           lambda target: self.filters(number, merging=True).write.mode("overwrite").parquet(target))


def store_first_sightings(requests: DataFrame, path: str, order: list[str], buckets: int = BUCKETS, merge_every: int = 10) -> DataFrame:
    """Requests of URLs never seen before in the stream, the first by ``order`` of those that share a micro-batch.

    URLs are compared normalized.  Late rows count like others.
    """
    spark = requests.sparkSession
    seen = SeenTable(spark, f"{path}/seen", buckets, merge_every)

    def write(batch: DataFrame, number: int) -> None:
        seen.merge(number)
        named = batch.withColumn("normalized", U.normalize(F.col("url")))
        fresh = seen.unseen(named, number)
        first = named.groupBy("normalized").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_f"))
        rows = first.join(fresh.select("normalized"), "normalized").select("normalized", "_f.*")
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        seen.add(fresh, number)
        forget(fresh)

    jobs.run_batches(requests, path, write)
    return spark.read.parquet(f"{path}/rows").drop("batch")
