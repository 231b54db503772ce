"""From documents to packed training sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteatlas.llm import decontaminate, line_runs, order_minhash, packing, quality_ledger
from siteatlas.llm.common import prepare, table, tokenizer_file
from siteatlas.llm.queries import CAPACITY, END_ID, TOKENIZER
from siteatlas.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    prepare(spark)
    return quality_ledger.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that an earlier one, or an earlier place, has already."""
    prepare(spark)
    return line_runs.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return order_minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file(TOKENIZER), END_ID, CAPACITY).drop("ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", benchmark), ("packing", packed)]

# Sketches, alignment and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
