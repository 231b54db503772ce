"""Stored tables: graphs, checkpoints, exports, documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


# ---- graphs -------------------------------------------------------------------

def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


# ---- crawl checkpoints ----------------------------------------------------------
#
# A checkpoint is one partition of each state table, named by its id.  The list
# table is written last, so a half-written checkpoint is never listed.

STATE_TABLES = ("queue", "visited", "canonical", "pagination")


def save_checkpoint(state: dict[str, DataFrame], path: str, checkpoint_id: str, taken_at: str) -> None:
    """Store the given state tables under ``checkpoint_id``."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", checkpoint_id):
        raise ValueError(f"not a checkpoint id: {checkpoint_id!r}")
    spark = next(iter(state.values())).sparkSession
    for name, table in state.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/checkpoint_id={checkpoint_id}")
    mark = spark.range(1).select(F.lit(checkpoint_id).alias("id"), F.lit(taken_at).cast("timestamp").alias("taken_at"))
    mark.write.mode("overwrite").parquet(f"{path}/checkpoints/checkpoint_id={checkpoint_id}")


def save_checkpoints(state: dict[str, DataFrame], path: str, taken: DataFrame) -> None:
    """Store the state of many crawls in one pass a table: rows with ``checkpoint_id``; ``taken`` holds (id, taken_at)."""
    for name, table in state.items():
        _write_partitions(table, f"{path}/{name}")
    marks = taken.select(F.col("id").cast("string").alias("id"), F.col("taken_at").cast("timestamp").alias("taken_at"))
    _write_partitions(marks.withColumn("checkpoint_id", F.col("id")), f"{path}/checkpoints")


def _write_partitions(rows: DataFrame, path: str) -> None:
    """Other checkpoints in the table stay; a hot one spans tasks and files."""
    wrong = F.raise_error(F.concat(F.lit("not a checkpoint id: "), F.coalesce("checkpoint_id", F.lit("null"))))
    valid = F.coalesce(F.col("checkpoint_id").rlike(r"^[A-Za-z0-9_.-]+$"), F.lit(False))
    named = rows.withColumn("checkpoint_id", F.when(valid, F.col("checkpoint_id")).otherwise(wrong)).hint("rebalance", "checkpoint_id")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("checkpoint_id").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """A state table with its ids as text."""
    stored = spark.read.parquet(path)
    text_id = T.StructType([T.StructField("checkpoint_id", T.StringType()) if f.name == "checkpoint_id" else f for f in stored.schema])
    return spark.read.schema(text_id).parquet(path)


def checkpoint_sizes(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(id, taken_at, rows of each named table) of the stored checkpoints, in one pass a table."""
    out = list_checkpoints(spark, path)
    for name in names:
        rows = _stored(spark, f"{path}/{name}").groupBy(F.col("checkpoint_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(rows, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def list_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(id, taken_at) of the stored checkpoints."""
    return spark.read.parquet(f"{path}/checkpoints").where(F.col("id").isNotNull()).select("id", "taken_at")


def latest_checkpoint(spark: SparkSession, path: str) -> str | None:
    newest = list_checkpoints(spark, path).agg(F.max_by("id", "taken_at").alias("id")).first()
    return newest["id"] if newest else None


def load_checkpoint(spark: SparkSession, path: str, name: str, checkpoint_id: str | None = None) -> DataFrame:
    """One state table of a checkpoint, the latest unless named; a partition filter.

    Ids are text: ``007`` and ``7`` are two checkpoints, so the partition column is not inferred.
    """
    wanted = checkpoint_id or latest_checkpoint(spark, path)
    return _stored(spark, f"{path}/{name}").where(F.col("checkpoint_id") == F.lit(wanted)).drop("checkpoint_id")


def delete_checkpoint(spark: SparkSession, path: str, checkpoint_id: str, names: tuple[str, ...] = STATE_TABLES) -> None:
    """Empty the partitions of a checkpoint and take it off the list."""
    for name in ("checkpoints", *names):
        folder = f"{path}/{name}/checkpoint_id={checkpoint_id}"
        kept = spark.read.parquet(folder)
        spark.createDataFrame([], kept.schema).write.mode("overwrite").parquet(folder)


# ---- exports --------------------------------------------------------------------

def export_project(tables: dict[str, DataFrame], project_id, path: str) -> None:
    """Write one project's rows of each table that has a ``project_id``."""
    for name, table in tables.items():
        table.where(F.col("project_id") == F.lit(project_id)).write.mode("overwrite").parquet(f"{path}/{name}")


def restore_project(spark: SparkSession, path: str, names: list[str], target: str) -> None:
    """Append an exported project to the tables under ``target``."""
    for name in names:
        spark.read.parquet(f"{path}/{name}").write.mode("append").parquet(f"{target}/{name}")


def export_user(projects: DataFrame, tables: dict[str, DataFrame], owner, path: str) -> None:
    """Write the rows of all projects of one user."""
    mine = projects.where(F.col("owner") == F.lit(owner)).select("project_id")
    for name, table in {"projects": projects, **tables}.items():
        table.join(mine, "project_id", "left_semi").write.mode("overwrite").parquet(f"{path}/{name}")


# ---- documents ------------------------------------------------------------------

def store_documents(lines: DataFrame, path: str) -> DataFrame:
    """Write document lines in order and return the byte size of each document.

    ``lines`` is (project_id, format, part, seq, line_no, line).  Range
    partitioning by project and place lets one large document span many files;
    file names sort in document order.
    """
    order = ["project_id", "format", "part", "seq", "line_no"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("project_id", "format", "line").write.mode("overwrite").partitionBy("project_id", "format").text(path)
    spark = lines.sparkSession
    written = spark.read.schema("value string, project_id string, format string").text(path)
    sizes = written.groupBy("project_id", "format").agg(
        (F.sum(F.octet_length("value") + 1) - 1).alias("size"), F.count(F.lit(1)).alias("lines"))
    kinds = {f.name: f.dataType for f in lines.schema}
    return sizes.select(F.col("project_id").cast(kinds["project_id"]).alias("project_id"), "format", "size", "lines")
