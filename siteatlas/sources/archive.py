"""Snapshot files: partitioned tables and per-snapshot metadata records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.operators import archive
from siteatlas.session import cut_lineage, scratch_path

METADATA = """snapshot_id string, project_id string, page_url string, page_url_hash string, page_title string,
  content_hash string, visual_hash string, http_status int, resource_count int, total_size_bytes bigint,
  captured_at timestamp, _corrupt string"""


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def store_snapshots(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write snapshot rows by project; URL hashes are sorted inside files.

    Sorting by (project, hash) lets a timeline read skip row groups.  Projects are
    brought together up to the advisory size, so a small one is one file and a
    large one many.  Project ids stay text.
    """
    spread = rows.hint("rebalance", "project_id")
    spread.sortWithinPartitions("project_id", "page_url_hash").write.mode(mode).partitionBy("project_id").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """One JSON record per snapshot, by project, with broken lines where capture failed."""
    fields = [c.split()[0] for c in METADATA.replace("\n", " ").split(",")][:-1]
    broken = F.when(F.col("seq") % 50 == 0, F.lit('{"snapshot_id": "cut'))
    lines = F.explode(F.array_compact(F.array(F.to_json(F.struct(*fields)), broken)))
    rows.select("project_id", lines.alias("value")).write.mode("overwrite").partitionBy("project_id").text(path)


def read_metadata(spark: SparkSession, path: str, project: str) -> DataFrame:
    """All readable snapshot records of one project, newest first."""
    found = spark.read.schema(METADATA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(
        f"{path}/project_id={project}")
    return found.where(F.col("snapshot_id").isNotNull()).orderBy(F.desc("captured_at")).drop("_corrupt")


# ---- a store by day, and what retention deletes of it ---------------------------

def store_days(rows: DataFrame, path: str) -> None:
    """Append snapshot rows (captured_at, seq, ...) to day partitions."""
    placed = rows.withColumn("day", F.date_format("captured_at", "yyyy-MM-dd")).hint("rebalance", "day")
    placed.write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    text_day = T.StructType([T.StructField("day", T.StringType()) if f.name == "day" else f for f in stored.schema])
    return spark.read.schema(text_day).parquet(path)


def delete(spark: SparkSession, path: str, removed: DataFrame) -> DataFrame:
    """Delete ``removed`` (day, seq and total_size_bytes of stored rows) and report what went, by day.

    A day that goes entirely is dropped as a folder, unread; one that goes in part
    is written again from what stays.
    """
    stored = read_days(spark, path)
    gone = cut_lineage(removed.select("day", "seq", "total_size_bytes"), "retention")
    per_day = gone.groupBy("day").agg(F.count(F.lit(1)).alias("deleted_snapshots"), F.sum("total_size_bytes").alias("freed_bytes"))
    there = stored.groupBy("day").agg(F.count(F.lit(1)).alias("_there"))
    report = cut_lineage(per_day.join(there, "day"), "retention-report")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in report.select("day", (F.col("deleted_snapshots") == F.col("_there")).alias("whole")).toLocalIterator():
        folder = f"{path}/day={row['day']}"
        if row["whole"]:
            files.delete(where(folder), True)
        else:
            left = stored.where(F.col("day") == row["day"]).join(gone.where(F.col("day") == row["day"]).select("seq"), "seq", "left_anti")
            cut_lineage(left.drop("day"), "retention-left").write.mode("overwrite").parquet(folder)
    return report.drop("_there")


def expire(spark: SparkSession, path: str, now, max_age_days: int) -> DataFrame:
    """Delete what is older than the age from a store by day."""
    last_day = F.date_format(now - F.make_dt_interval(F.lit(max_age_days)), "yyyy-MM-dd")
    return delete(spark, path, archive.expired(read_days(spark, path).where(F.col("day") <= last_day), now, max_age_days))


def fit_quota(spark: SparkSession, path: str, limit_bytes: int) -> DataFrame:
    """Delete the oldest snapshots of a store by day until it fits."""
    return delete(spark, path, archive.over_quota(read_days(spark, path), limit_bytes))
