"""Sitemap files read with the built-in XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.session import cut_lineage

ENTRY = "loc string, lastmod string, changefreq string, priority string"


def read_sitemap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(at, file, url, lastmod, changefreq, priority) of every <url> record.

    ``at`` is its place: rows of one split come in file order, and splits are
    told apart by where they begin.
    """
    raw = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", "true").schema(ENTRY).load(paths)
    rows = raw.select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("_metadata.file_path").alias("file"), X.trimmed(F.col("loc")).alias("url"),
        F.try_to_timestamp(X.trimmed(F.col("lastmod"))).alias("lastmod"), X.trimmed(F.col("changefreq")).alias("changefreq"),
        X.trimmed(F.col("priority")).try_cast("double").alias("priority"))
    return rows.where(F.col("url") != "")


def read_index(spark: SparkSession, paths: str | list[str], first: int = 10) -> DataFrame:
    """(file, url): the first ``first`` sub-sitemaps of each index file.

    The source gives no record number; file order is the order of the rows of
    one split, which an index file (50,000 entries at most by the protocol) is.
    """
    raw = spark.read.format("xml").option("rowTag", "sitemap").option("recursiveFileLookup", "true").schema("loc string").load(paths)
    numbered = raw.select(F.col("_metadata.file_path").alias("file"), X.trimmed(F.col("loc")).alias("url"),
                          F.monotonically_increasing_id().alias("_n"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("_n"))
    return numbered.withColumn("position", rank).where(F.col("position") <= first).drop("_n")


def expanded(spark: SparkSession, folder: str, index: str = "index", first: int = 10) -> DataFrame:
    """Entries of the sitemaps that an index lists, also through indexes that it lists.

    ``folder`` holds the fetched files, or folders of their parts, under the last
    segment of their URL.
    Rounds follow indexes until no new file is named; of each the first ``first``
    sub-sitemaps count.  A file that lists sub-sitemaps has no entries of its own.
    """
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    own = F.substring_index(F.substring_index("file", f"{base}/", -1), "/", 1)
    child = F.regexp_extract("url", r"([^/]+)/?$", 1)
    listed = cut_lineage(read_index(spark, f"{folder}/*", first).select(own.alias("parent"), child.alias("child")), "sitemap-index")
    reached = cut_lineage(spark.range(1).select(F.lit(index).alias("file")), "sitemap-reached")
    newest = reached
    while True:
        step = newest.join(listed, newest["file"] == listed["parent"]).select(F.col("child").alias("file")).distinct()
        newest = cut_lineage(step.join(reached, "file", "left_anti"), "sitemap-newest")
        if newest.isEmpty():
            break
        reached = reached.unionAll(newest)
    leaves = reached.join(listed, reached["file"] == listed["parent"], "left_anti").select(F.col("file").alias("_name"))
    entries = read_sitemap(spark, f"{folder}/*").withColumn("_name", own)
    return entries.join(leaves, "_name", "left_semi").drop("_name")


def discovered(entries: DataFrame, scope: U.Scope, max_pages: int) -> DataFrame:
    """The first ``max_pages`` entries in order of discovery, one per URL, then those in scope."""
    first = entries.groupBy("url").agg(F.min_by(F.struct("at", "file", "lastmod", "changefreq", "priority"), "at").alias("e"))
    kept = first.select("url", "e.*", X.sitemap_priority(F.col("e.priority")).alias("crawl_priority"))
    return kept.orderBy("at").limit(max_pages).where(U.scope_reason(F.col("url"), scope).isNull()).drop("at")
