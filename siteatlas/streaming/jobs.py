"""Structured Streaming jobs over crawl events, requests and snapshots.

Every job is a transformation of a streaming DataFrame; ``run`` starts it with
a file sink or a batch writer.  Event time and watermarks bound the state that
the batch forms do not need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.operators import archive, blocks, ordered, stats

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Files of one micro-batch.
PER_TRIGGER = 64


# ---- running -------------------------------------------------------------------

def run(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Append the stream's rows to files until the input is used up, and read them."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    (stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_batches(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand each micro-batch to ``write(batch, number)`` until the input is used up."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())


def run_upserts(stream: DataFrame, keys: list[str], path: str, compact_every: int = 10) -> DataFrame:
    """Keep the newest row per key of an aggregate that runs in update mode.

    A batch only writes its own partition, over itself when it is retried, so a
    restart cannot count twice.  Every ``compact_every`` batches the newest rows
    are merged into one folder and what they replace is dropped, so the table
    grows with its keys, not with its batches.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/kind=update/batch={number}")
        if number % compact_every == compact_every - 1:
            _newest(spark, keys, path).write.mode("overwrite").parquet(f"{path}/rows/kind=merged/batch={number}")
            drop_batches(spark, f"{path}/rows/kind=update", number + 1)
            drop_batches(spark, f"{path}/rows/kind=merged", number)

    run_batches(stream, path, write, "update")
    return _newest(spark, keys, path)


def _newest(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    written = spark.read.parquet(f"{path}/rows")
    values = [c for c in written.columns if c not in (*keys, "batch", "kind")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("batch", "kind")).alias("_v"))
    return newest.select(*keys, "_v.*")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Delete the ``batch=`` folders with a smaller number."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where):
        for entry in files.listStatus(where):
            name = entry.getPath().getName()
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < before:
                files.delete(entry.getPath(), True)


def merge_batches(spark: SparkSession, folder: str, number: int, every: int, write: Callable[[str], None]) -> None:
    """At the start of every ``every``-th batch: one folder in place of those of all earlier batches.

    ``write(target)`` writes what ``earlier`` gives.  Where a merge was cut short it is done again, as the folder counts once it is
    complete; only then the others go.  Rows that are in both meanwhile must do no harm.
    """
    if not number or number % every:
        return
    target = f"{folder}/kind=merged/batch={number - 1}"
    if not exists(spark, f"{target}/_SUCCESS"):
        write(target)
    drop_batches(spark, f"{folder}/kind=update", number)
    drop_batches(spark, f"{folder}/kind=merged", number - 1)


def earlier(spark: SparkSession, folder: str, schema: str, number: int, merging: bool = False) -> DataFrame:
    """Rows of the batches before ``number``, with kind and batch; while ``merging``, without the folder that is being made."""
    schema = f"{schema}, kind string, batch int"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder).where(F.col("batch") < number)
    return rows.where(~((F.col("kind") == "merged") & (F.col("batch") == number - 1))) if merging else rows


# ---- aggregates ------------------------------------------------------------------

def usage_windows(records: DataFrame, late: str = "1 minute") -> DataFrame:
    """Quantity by user and event in 30-second windows."""
    counted = records.withWatermark("ts", late).groupBy(F.window("ts", "30 seconds"), "user_id", "event").agg(
        F.sum("quantity").alias("quantity"))
    return counted.select(F.col("window.start").alias("window_start"), "user_id", "event", "quantity")


def domain_rates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests per minute by domain over the last five minutes, each minute."""
    counted = events.withWatermark("event_time", late).groupBy(F.window("event_time", "5 minutes", "1 minute"), "domain").agg(
        F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("window.start").alias("window_start"), "domain", "requests",
                          (F.col("requests") / 5).alias("per_minute"))


def crawl_progress(events: DataFrame) -> DataFrame:
    """Visited pages, errors and the last error of each session so far."""
    failed = F.col("kind") == "failure"
    return events.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "success").alias("visited"), F.count_if(failed).alias("errors"),
        F.max(F.when(failed, F.struct("seq", "error_message"))).alias("_last")).select(
        "session_id", "visited", "errors", F.col("_last.error_message").alias("last_error"))


def session_states(changes: DataFrame) -> DataFrame:
    """Status of each session: the latest change, later states first among equals."""
    rank = F.array_position(F.array(*[F.lit(s) for s in stats.SESSION_STATES]), F.col("status"))
    return changes.groupBy("session_id").agg(F.max_by("status", F.struct("event_time", rank.alias("rank"))).alias("status"))


def metrics(observations: DataFrame) -> DataFrame:
    return stats.histogram(observations)


# ---- block signals -----------------------------------------------------------------

def store_block_signals(events: DataFrame, path: str, threshold: int = 5, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Streak, challenges, multiplier and signal after each event of a domain.

    A micro-batch is worked out by the batch operators, which cut a busy
    domain's events into chunks and carry sums between them.  Between batches
    only two numbers a domain are kept: its trailing failures and challenges, in
    a table that each batch writes anew.  Within a batch events count by ``seq``.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("domain", "seq", "kind", "error_message")
        success, failure, challenge = (F.col("kind") == k for k in ("success", "failure", "challenge"))
        chunk = [ordered.chunk_of("seq", chunk_rows)]
        run = ordered.running_streak(rows, ["domain"], chunk, ["seq"], failure, success, "streak")
        run = ordered.running_totals(run, ["domain"], chunk, ["seq"], {
            "challenges": challenge.cast("bigint"), "_successes": success.cast("bigint")})
        known = "domain string, _streak bigint, _met bigint"
        state = spark.read.schema(known).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], known)
        carried = run.join(state, "domain", "left")
        streak = F.col("streak") + F.when(F.col("_successes") == 0, F.coalesce("_streak", F.lit(0))).otherwise(0)
        out = carried.select("domain", "seq", "kind", "error_message", streak.alias("streak"),
                             (F.col("challenges") + F.coalesce("_met", F.lit(0))).alias("challenges"))
        blocks.signals(out, threshold).select(*BLOCK_COLUMNS).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        signalled = spark.read.parquet(f"{path}/rows/batch={number}")
        last = signalled.groupBy("domain").agg(F.max_by(F.struct("streak", "challenges"), "seq").alias("_l")).select(
            "domain", F.col("_l.streak").alias("_streak"), F.col("_l.challenges").alias("_met"))
        kept = state.join(last, "domain", "left_anti").unionByName(last)
        kept.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        drop_batches(spark, f"{path}/state", number - 1)

    run_batches(events, path, write)
    return spark.read.parquet(f"{path}/rows").drop("batch")


BLOCK_COLUMNS = ("domain", "seq", "streak", "challenges", "multiplier", "reason", "recommended_action")


# ---- snapshots ---------------------------------------------------------------------------------

def store_with_previous(snapshots: DataFrame, path: str, merge_every: int = 10) -> DataFrame:
    """Append snapshots with the hash and id of the URL's previous one by capture time.

    A late snapshot takes the last one before it, and the one after it is
    written again with the late one as its previous; of the versions of a row the
    newest counts.  Rows are laid out by the first digits of the URL hash; a
    batch reads the buckets of its URLs only.  Before every ``merge_every``-th batch the folders of the earlier ones are merged, so
    their number stays bounded.
    """
    spark = snapshots.sparkSession
    fields = ["snapshot_id", "content_hash"]
    old = {"previous_snapshot_id": F.lit(""), "previous_content_hash": F.lit(""), "bucket": F.lit("")}
    layout = snapshots.withColumns(old).schema
    schema, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout), layout.fieldNames()

    def write(batch: DataFrame, number: int) -> None:
        def merge(target: str) -> None:
            newest = _newest_versions(earlier(spark, f"{path}/rows", schema, number, merging=True)).select(*columns)
            newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)

        merge_batches(spark, f"{path}/rows", number, merge_every, merge)
        fresh = batch.withColumns({"bucket": bucket_of("page_url_hash"), "_new": F.lit(True), "_was": F.lit(None).cast("string")})
        if number:
            buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # 256 at most
            stored = _newest_versions(earlier(spark, f"{path}/rows", schema, number).where(F.col("bucket").isin(buckets)))
            related = stored.join(fresh.select("page_url_hash").distinct(), "page_url_hash", "left_semi")
            fresh = fresh.unionByName(related.select(*snapshots.columns, "bucket", F.lit(False).alias("_new"),
                                                     F.col("previous_snapshot_id").alias("_was")))
        linked = archive_previous(fresh, fields)
        changed = linked.where(F.col("_new") | ~F.col("_p.snapshot_id").eqNullSafe(F.col("_was")))
        out = changed.select(*snapshots.columns, F.col("_p.snapshot_id").alias("previous_snapshot_id"),
                             F.col("_p.content_hash").alias("previous_content_hash"), "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/kind=update/batch={number}")

    run_batches(snapshots, path, write)
    return _newest_versions(earlier(spark, f"{path}/rows", schema, 1 << 30)).drop("bucket")


def _newest_versions(rows: DataFrame) -> DataFrame:
    key = ["page_url_hash", "captured_at", "seq"]
    rest = [c for c in rows.columns if c not in (*key, "kind", "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*key, "_v.*")


def bucket_of(name: str) -> Column:
    return F.substring(name, 1, 2)


def archive_previous(batch: DataFrame, fields: list[str]) -> DataFrame:
    """Add the struct ``_p`` of the URL's previous row within the batch."""
    chunk = F.floor(F.unix_micros("captured_at") / (archive.SPAN_SECONDS * 1_000_000)).cast("bigint")
    return ordered.previous_row(batch, ["page_url_hash"], [chunk], ["captured_at", "seq"], fields, "_p")


def snapshot_stream(pages: DataFrame) -> DataFrame:
    """Snapshot rows of a stream of captured pages."""
    return pages.select("seq", "snapshot_id", "captured_at", U.url_hash(F.col("page_url")).alias("page_url_hash"),
                        X.content_hash(F.col("html")).alias("content_hash"))


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """A stream of files, at most ``per_trigger`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
