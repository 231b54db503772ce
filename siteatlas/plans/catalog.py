"""The query catalog: each entry pairs a Spark job with its check, if it has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.session import tune
from siteatlas.sources import standins


class Tables:
    """The given tables of one folder and the relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str, splits: int | None = None):
        """``splits``: deal the pages out to so many tasks; for one-file tables in a bench, never for a table of many files."""
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self.splits = splits

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        pages = self.read("pages")
        return pages.repartition(self.splits) if self.splits else pages

    @cached_property
    def rich_pages(self) -> DataFrame:
        return self.spark.sql(standins.RICH_PAGES, pages=self.pages)

    @cached_property
    def events(self) -> DataFrame:
        raw = self.read("events")
        return raw.withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def crawl_events(self) -> DataFrame:
        return self.spark.sql(standins.CRAWL_EVENTS, events=self.events)

    @cached_property
    def snapshots(self) -> DataFrame:
        raw = self.spark.sql(standins.SNAPSHOTS, documents=self.read("documents"))
        return raw.withColumn("captured_at", F.timestamp_micros("captured_us"))

    @cached_property
    def urls(self) -> DataFrame:
        """(page_id, k, url): every URL shape of every page."""
        return self.spark.sql(
            f"SELECT page_id, posexplode(array({standins.URL_SHAPES})) AS (k, url) FROM {{pages}}", pages=self.pages)

    @cached_property
    def page_links(self) -> DataFrame:
        """(src, dst, position) between the given pages."""
        count = self.pages.agg(F.count(F.lit(1))).scalar()
        hops = F.when(F.col("page_id") % 9 > 0, F.sequence(F.lit(1), F.least(F.lit(8), F.col("page_id") % 9)))
        return (self.pages.select(F.col("page_id").alias("src"), F.explode(hops).alias("k"), count.alias("n"))
                .select("src", ((F.col("src") * 7 + F.col("k") * F.col("k")) % F.col("n")).alias("dst"),
                        (F.col("k") - 1).cast("int").alias("position"))
                .where("src <> dst"))


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}

# Check-side text of the derived relations.
CTE_URLS = (f"urls AS (SELECT page_id, unnest(range(len(l))) AS k, unnest(l) AS url "
            f"FROM (SELECT page_id, [{standins.URL_SHAPES}] AS l FROM pages))")
CTE_RICH = f"rich AS ({standins.RICH_PAGES.format(pages='pages')})"
CTE_EVENTS = f"ev AS ({standins.CRAWL_EVENTS.format(events='events')})"
CTE_SNAPS = f"snaps AS ({standins.SNAPSHOTS.format(documents='documents')})"
CTE_LINKS = ("page_links AS (SELECT src, dst, k - 1 AS position FROM (SELECT page_id AS src, k, "
             "(page_id * 7 + k * k) % (SELECT count(*) FROM pages) AS dst "
             "FROM pages, (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) v(k) WHERE k <= page_id % 9) WHERE src <> dst)")


def query(name: str, sql: str | None = None):
    """Register a job under its inventory name."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(build, sql)
        return build

    return keep


def load() -> dict[str, Entry]:
    """All entries; importing the modules registers them."""
    import importlib

    for part in ("urls", "text", "extract", "classify", "stats", "archive", "windows", "dedup", "graph", "joins", "frontier", "documents", "streams"):
        importlib.import_module(f"siteatlas.plans.queries_{part}")
    return ENTRIES
