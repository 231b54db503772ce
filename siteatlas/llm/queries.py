"""Queries of this subpackage: each operator over its whole table, and its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteatlas.llm import (
    chat_format,
    checks,
    decontaminate,
    divergence,
    licenses,
    line_runs,
    order_minhash,
    packing,
    quality_ledger,
    ranked_search,
    substrings,
    token_files,
    toxicity,
    url_blocks,
)
from siteatlas.llm.common import table, tokenizer_file
from siteatlas.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 2, 4096


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op2_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_runs.digest(line_runs.remove(table(spark, folder, "documents")))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write(docs, path, tokenizer_file(TOKENIZER), END_ID)
    return token_files.digest(token_files.read(spark, path))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


def op5_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return quality_ledger.digest(quality_ledger.ledger(table(spark, folder, "documents")))


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.remove(table(spark, folder, "documents")))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.digest(order_minhash.group(table(spark, folder, "documents")))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file(TOKENIZER), END_ID, CAPACITY).drop("ids")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels"))))


def op10_url_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return url_blocks.digest(url_blocks.judge_pages(table(spark, folder, "pages")))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.digest(ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.digest(divergence.audit(table(spark, folder, "documents")))


# A conversation whose texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """The given turns and the probe, as records of four layouts, formatted into files and read back from them."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chat")
    chat_format.write(chat_format.convert(chat_format.as_records(turns.unionByName(probe))), path)
    return chat_format.digest(spark.read.parquet(path))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_line_runs, op3_token_files, op4_licenses, op5_quality_ledger, op6_substrings,
    op7_order_minhash, op8_packing, op9_toxicity, op10_url_blocks, op11_ranked_search,
    op12_source_divergence, op13_chat_format)}

SQL: dict[str, str] = checks.SQL
