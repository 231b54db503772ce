"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.session import tune

# Rows and bytes of one Arrow batch: large enough for bulk work, bounded for Python workers.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    tune(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the folder is installed as a module or named by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` of a table, whatever else it holds; a null text becomes empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def text_mark(text: Column) -> Column:
    """Tells documents that share an id apart: rows equal in both are one document stored twice."""
    return F.xxhash64(text)


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, so that no name of theirs meets a name of ours."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)


def unpacked(columns: list[str], replaced: dict[str, Column] | None = None, name: str = "row") -> list[Column]:
    """The columns of ``whole_row`` again, some of them replaced."""
    replaced = replaced or {}
    return [replaced[c].alias(c) if c in replaced else F.col(f"{name}.`{c}`").alias(c) for c in columns]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from one pass over that column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, rows: int | None = None, rows_per_task: int = 200_000) -> DataFrame:
    """A written table in as few tasks as its rows need, which spares small tables the work of a shuffle of many."""
    n = df.count() if rows is None else rows
    tasks = max(1, -(-n // rows_per_task))
    return df.coalesce(tasks) if tasks < shuffle_width(df.sparkSession) else df
