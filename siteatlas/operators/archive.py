"""Snapshot history: capture rows, latest, change, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.operators import ordered
from siteatlas.session import cut_lineage

SPAN_SECONDS = 600  # one URL is captured at most once per millisecond


def snapshot_rows(pages: DataFrame) -> DataFrame:
    """Snapshot metadata of captured pages; ``html`` and ``screenshot`` stay behind.

    Needs page_url, html, screenshot (nullable binary), project_id, captured_at
    and whatever else should be carried along.
    """
    carried = [c for c in pages.columns if c not in ("html", "screenshot")]
    content = X.content_hash(F.col("html"))
    size = F.octet_length("html") + F.coalesce(F.octet_length("screenshot"), F.lit(0))
    return pages.select(
        *carried, U.url_hash(F.col("page_url")).alias("page_url_hash"),
        H.title(H.drop_scripts(F.col("html"))).alias("page_title"),
        content.alias("content_hash"), X.visual_hash(F.col("screenshot"), content).alias("visual_hash"),
        H.resource_count(F.col("html")).alias("resource_count"), size.cast("bigint").alias("total_size_bytes"))


def latest_per_url(snapshots: DataFrame, order: list[str], key: str = "url_hash") -> DataFrame:
    """Newest row per URL, with all its columns, in one combined aggregate.

    Give it narrow rows: extract what is wanted of a page's text before.
    """
    return latest_fields(snapshots, order, [c for c in snapshots.columns if c != key], key).select(snapshots.columns)


def latest_fields(snapshots: DataFrame, order: list[str], columns: list[str], key: str = "url_hash") -> DataFrame:
    """Narrow columns of the newest row per URL, in one combined aggregate."""
    newest = snapshots.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v"))
    return newest.select(key, "_v.*")


def timeline(snapshots: DataFrame, url: str) -> DataFrame:
    """All snapshots of one URL, oldest first."""
    return snapshots.where(F.col("page_url_hash") == U.url_hash(F.lit(url))).orderBy("captured_at")


def _changed(now: Column, before: Column) -> Column:
    return F.when(before.isNotNull(), ~now.eqNullSafe(before))


def change_history(snapshots: DataFrame) -> DataFrame:
    """Add the previous snapshot of the URL and what changed since it."""
    fields = ["snapshot_id", "content_hash", "visual_hash", "http_status", "captured_at"]
    chunk = F.floor(F.unix_micros("captured_at") / (SPAN_SECONDS * 1_000_000)).cast("bigint")
    rows = ordered.previous_row(snapshots, ["page_url_hash"], [chunk], ["captured_at", "seq"], fields, "_p")
    known = F.col("_p").isNotNull()
    return rows.select(
        *snapshots.columns, F.col("_p.snapshot_id").alias("previous_snapshot_id"),
        _changed(F.col("content_hash"), F.col("_p.content_hash")).alias("text_changed"),
        _changed(F.col("visual_hash"), F.col("_p.visual_hash")).alias("visual_changed"),
        F.when(known, F.col("http_status") != F.col("_p.http_status")).alias("status_changed"),
        ((F.unix_micros("captured_at") - F.unix_micros("_p.captured_at")) / 1_000_000).alias("seconds_since"))


def compare(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Compare chosen snapshots: pairs holds ``first_id`` and ``second_id``."""
    fields = ["snapshot_id", "content_hash", "visual_hash", "http_status", "captured_at"]
    a = snapshots.select(*[F.col(c).alias(f"a_{c}") for c in fields])
    b = snapshots.select(*[F.col(c).alias(f"b_{c}") for c in fields])
    both = pairs.join(a, F.col("first_id") == F.col("a_snapshot_id")).join(b, F.col("second_id") == F.col("b_snapshot_id"))
    text = F.col("a_content_hash") != F.col("b_content_hash")
    visual = F.col("a_visual_hash") != F.col("b_visual_hash")
    gap = (F.unix_micros("b_captured_at") - F.unix_micros("a_captured_at")) / 1000
    return both.select(
        "first_id", "second_id", text.alias("text_changed"), visual.alias("visual_changed"),
        F.when(text, 0.5).otherwise(1.0).alias("text_similarity"), F.when(visual, 0.5).otherwise(1.0).alias("visual_similarity"),
        (F.col("a_http_status") != F.col("b_http_status")).alias("status_changed"), F.abs(gap).alias("time_difference_ms"))


def expired(snapshots: DataFrame, now: Column, max_age_days: int = 30) -> DataFrame:
    """Snapshots older than the limit; a plain range filter that scans can skip by."""
    return snapshots.where(F.col("captured_at") < now - F.make_dt_interval(F.lit(max_age_days)))


def kept_within_age(snapshots: DataFrame, now: Column, max_age_days: int = 30) -> DataFrame:
    return snapshots.where(F.col("captured_at") >= now - F.make_dt_interval(F.lit(max_age_days)))


def cleanup_report(removed: DataFrame) -> DataFrame:
    return removed.agg(F.count(F.lit(1)).alias("deleted_snapshots"), F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("freed_bytes"))


def _split_by_bucket(rows: DataFrame, bucket: Column, need: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that go entirely, and rows of the bucket the limit falls in.

    ``_base`` holds the bytes older than all rows.  The window runs over bucket
    sums: days, or the seconds of one day.
    """
    keyed = rows.withColumn("_bucket", bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum("total_size_bytes").alias("_bytes"), F.max("_base").alias("_floor"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.col("_floor") + F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)))
    sums = sums.select("_bucket", "_start", (F.col("_start") + F.col("_bytes")).alias("_stop"), need.alias("_need"))
    joined = keyed.join(sums.where("_start < _need"), "_bucket")
    whole = joined.where("_stop <= _need").drop("_bucket", "_start", "_stop", "_need")
    edge = joined.where("_stop > _need").withColumn("_base", F.col("_start")).drop("_bucket", "_start", "_stop")
    return whole, edge


def over_quota(snapshots: DataFrame, limit_bytes: int) -> DataFrame:
    """Oldest snapshots to delete until the archive fits ``limit_bytes``.

    A running sum over the whole archive would be one task.  The limit falls
    into one day, and there into one second; only that second's rows are put
    in order, chunk by chunk.
    """
    snapshots = cut_lineage(snapshots, "quota")  # read four times below
    need = snapshots.agg(F.coalesce(F.sum("total_size_bytes"), F.lit(0)) - F.lit(limit_bytes)).scalar()
    rows = snapshots.withColumn("_base", F.lit(0).cast("bigint"))
    day = F.floor(F.unix_micros("captured_at") / 86_400_000_000)
    second = F.floor(F.unix_micros("captured_at") / 1_000_000)
    days, edge_day = _split_by_bucket(rows, day, need)
    seconds, edge = _split_by_bucket(edge_day.drop("_need"), second, need)
    counted = ordered.running_totals(edge, [], [F.col("captured_at"), ordered.chunk_of("seq")], ["captured_at", "seq"],
                                     {"_sum": F.col("total_size_bytes")})
    last = counted.where(F.col("_base") + F.col("_sum") - F.col("total_size_bytes") < F.col("_need"))
    columns = snapshots.columns
    return days.select(columns).unionByName(seconds.select(columns)).unionByName(last.select(columns))


def pending_analysis(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("analysis_json").isNull())
