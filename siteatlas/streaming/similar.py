"""Near-duplicate decisions over a stream of fingerprints, a busy title cut over many tasks.

A page is compared with the newest ``memory`` kept pages of its title, and a structure once kept is never kept again.  As long as no
kept page falls out of that memory within a micro-batch, the batch is the batch problem with the remembered pages settled beforehand,
and ``neardup.settle`` decides all titles in parallel, in blocks.  Titles that keep more than they remember are decided once more, page
by page in order, as a stream of sorted rows: a task holds the memory of one title and no group.

Between batches only the kept pages are stored, numbered by title, in folders that are merged now and then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.operators import dedup, neardup
from siteatlas.session import cut_lineage, forget
from siteatlas.streaming import jobs

KEPT = "title string, links long, forms long, length long, k long"
BEFORE = -(1 << 62)  # remembered pages come before those of a batch, in their own order


def _in_turn(threshold: float, memory: int):
    """Decisions of sorted rows (title, seq, links, forms, length, old), remembered pages first."""

    def similar(a, b) -> bool:
        apart = min(abs(a[0] - b[0]) + abs(a[1] - b[1]), 20)
        longest = max(a[2], b[2])
        ratio = 1.0 - min(abs(a[2] - b[2]) / longest, 1.0) if longest > 0 else 1.0
        return 0.4 + (1.0 - apart / 20.0) * 0.3 + ratio * 0.3 >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ring, shapes = None, [], set()
        for batch in batches:
            out = []
            for title, seq, links, forms, length, old in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if title != now:
                    now, ring, shapes = title, [], set()
                page = (links, forms, length)
                said = "kept"
                if not old:
                    said = "structure" if page[:2] in shapes else "similar" if any(similar(page, k) for k in ring) else "kept"
                    out.append((title, seq, links, forms, length, said))
                if said == "kept":
                    ring = [*ring[-(memory - 1):], page] if memory > 1 else [page]
                    shapes.add(page[:2])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    names=["title", "seq", "links", "forms", "length", "decision"])

    return run


def store_similarity(prints: DataFrame, path: str, threshold: float = 0.85, memory: int = 100, merge_every: int = 10,
                     block_points: int | None = None) -> DataFrame:
    """``seq, decision`` (kept, structure or similar) of fingerprints (site, title, links, forms, length, seq), by seq within a batch."""
    reach = dedup.max_distance(threshold)
    spark, fields = prints.sparkSession, ["links", "forms", "length"]
    name = F.to_json(F.struct(F.coalesce("site", F.lit("")).alias("s"), F.coalesce("title", F.lit("")).alias("t")))

    def write(batch: DataFrame, number: int) -> None:
        jobs.merge_batches(spark, f"{path}/kept", number, merge_every, lambda target: jobs.earlier(
            spark, f"{path}/kept", KEPT, number, merging=True).drop("kind", "batch").distinct().write.mode("overwrite").parquet(target))
        stored = jobs.earlier(spark, f"{path}/kept", KEPT, number).drop("kind", "batch").distinct()
        rows = cut_lineage(batch.select(name.alias("title"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("long") for c in fields]), "similar-rows")
        state = cut_lineage(stored.join(rows.select("title").distinct(), "title", "left_semi"), "similar-state")
        counts = state.groupBy("title").agg(F.max("k").alias("most"))
        ring = state.join(counts, "title").where(F.col("k") > F.col("most") - memory).select(
            "title", *fields, (F.col("k") + BEFORE).alias("seq"))
        again = rows.join(state.select("title", "links", "forms", F.lit(True).alias("again")), ["title", "links", "forms"], "left")
        fresh = cut_lineage(again.where("again is null").drop("again"), "similar-fresh")
        settled, _ = neardup.settle(fresh.groupBy("title", *fields).agg(F.min("seq").alias("seq")), threshold, reach, block_points, ring)
        new = settled.where(F.col("seq") >= BEFORE // 2)
        grown = new.groupBy("title").agg(F.count(F.lit(1)).alias("n")).join(counts, "title", "left")
        over = cut_lineage(grown.where(F.coalesce("most", F.lit(0)) + F.col("n") > memory).select("title"), "similar-over")
        calm = fresh.join(over, "title", "left_anti").join(
            new.select("title", "links", "forms", F.col("seq").alias("first")), ["title", "links", "forms"], "left")
        calm = calm.withColumn("decision", F.when(F.col("first") == F.col("seq"), "kept").when(F.col("first") < F.col("seq"), "structure").otherwise("similar"))
        busy = fresh.select("title", "seq", *fields, F.lit(False).alias("old")).unionByName(
            ring.select("title", "seq", *fields, F.lit(True).alias("old"))).join(over, "title", "left_semi")
        turns = busy.repartition("title").sortWithinPartitions("title", "seq").select("title", "seq", *fields, "old").mapInArrow(
            _in_turn(threshold, memory), "title string, seq long, links long, forms long, length long, decision string")
        told = cut_lineage(calm.select("title", "seq", *fields, "decision").unionByName(turns), "similar-told")
        place = F.row_number().over(Window.partitionBy("title").orderBy("seq"))
        kept = told.where("decision = 'kept'").withColumn("_n", place).join(counts, "title", "left")
        kept.select("title", *fields, (F.coalesce("most", F.lit(0)) + F.col("_n")).cast("long").alias("k")).write.mode("overwrite").parquet(
            f"{path}/kept/kind=update/batch={number}")
        repeats = again.where("again").select("seq", F.lit("structure").alias("decision"))
        told.select("seq", "decision").unionByName(repeats).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        for used in (rows, state, fresh, over, told):
            forget(used)

    jobs.run_batches(prints, path, write)
    return spark.read.parquet(f"{path}/rows").drop("batch")
