"""Aggregates over crawl events, archives, projects and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.operators import ordered

# ---- fixed values -----------------------------------------------------------
HISTOGRAM_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
SESSION_STATES = ["PENDING", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"]
# -----------------------------------------------------------------------------


def half_up(value: Column) -> Column:
    """Nearest integer of a non-negative number, halves up."""
    return F.floor(value + F.lit(0.5))


def _of(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def crawl_stats(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts, mean time and rate per session; retries are not requests."""
    elapsed = (F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))) / 1000
    base = events.groupBy(key).agg(
        _of("success").alias("success_count"), _of("failure").alias("failed_count"), _of("skip").alias("skipped_count"),
        _of("retry").alias("retry_count"), elapsed.alias("elapsed_ms"),
        F.avg(F.when(F.col("kind") == "success", F.col("duration_ms"))).alias("_mean"))
    total = F.col("success_count") + F.col("failed_count") + F.col("skipped_count")
    rate = F.when(F.col("elapsed_ms") > 0, half_up(total / (F.col("elapsed_ms") / 60000) * 10) / 10).otherwise(F.lit(0.0))
    return base.select(
        key, total.alias("total_requests"), "success_count", "failed_count", "skipped_count", "retry_count",
        half_up(F.coalesce("_mean", F.lit(0.0))).alias("avg_processing_ms"), rate.alias("requests_per_minute"), "elapsed_ms")


def errors_by_type(events: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, error_key, errors): one row per kind of failure."""
    failed = events.where(F.col("kind") == "failure")
    return failed.groupBy(key, X.error_key(F.col("error_type"), F.col("error_message")).alias("error_key")).agg(
        F.count(F.lit(1)).alias("errors"))


def domain_stats(events: DataFrame) -> DataFrame:
    """Per domain with at least one success or failure."""
    base = events.groupBy("domain").agg(
        _of("success").alias("success_count"), _of("failure").alias("failed_count"),
        F.avg(F.when(F.col("kind") == "success", F.col("duration_ms"))).alias("_mean"),
        _of("challenge").alias("challenge_count"))
    return base.where(F.col("success_count") + F.col("failed_count") > 0).select(
        "domain", "success_count", "failed_count", half_up(F.coalesce("_mean", F.lit(0.0))).alias("avg_load_ms"),
        "challenge_count")


def crawl_summary(events: DataFrame) -> DataFrame:
    """Distinct pages visited per second of each session."""
    seconds = (F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))) / 1000000
    pages = F.countDistinct(F.when(F.col("kind").isin("success", "failure"), F.col("_page")))
    return (events.withColumn("_page", U.normalize(F.col("url"))).groupBy("session_id")
            .agg(pages.alias("visited"), seconds.alias("_s")).select(
                "session_id", "visited", (F.col("visited") / F.greatest(F.lit(1.0), F.col("_s"))).alias("pages_per_second")))


def grouped_errors(events: DataFrame, keep: int = 1000, urls: int = 5) -> DataFrame:
    """Last ``keep`` errors per session by error key: count, first URLs, last seen."""
    failed = events.where(F.col("kind") == "failure").select(
        "session_id", "seq", "url", "event_time", X.error_key(F.col("error_type"), F.col("error_message")).alias("error_key"),
        (-F.col("seq")).alias("_newest"))
    recent = ordered.first_n(failed, ["session_id"], ["_newest"], keep).drop("rank")
    sums = recent.groupBy("session_id", "error_key").agg(F.count(F.lit(1)).alias("errors"), F.max("event_time").alias("last_seen"))
    first = (ordered.first_n(recent, ["session_id", "error_key"], ["seq"], urls).groupBy("session_id", "error_key")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("_urls")))
    return sums.join(first, ["session_id", "error_key"]).select(
        "session_id", "error_key", "errors", F.transform("_urls", lambda u: u["url"]).alias("urls"), "last_seen")


def recent_errors(events: DataFrame, n: int = 10) -> DataFrame:
    return events.where(F.col("kind") == "failure").orderBy(F.desc("seq")).limit(n)


def with_pattern(pages: DataFrame) -> DataFrame:
    return pages.withColumn("pattern", U.pattern(F.col("url")))


def pattern_cap(requests: DataFrame, cap: int = 3) -> DataFrame:
    """Add ``kept`` and ``reason``: at most ``cap`` URLs per pattern, in arrival order."""
    marked = ordered.mark_first_n(with_pattern(requests), ["pattern"], ["seq"], cap, "kept")
    reason = F.concat(F.lit("Pattern '"), F.col("pattern"), F.lit(f"' already crawled {cap} times. Skipping repetitive URL."))
    return marked.withColumn("reason", F.when(~F.col("kept"), reason))


def pattern_counts(requests: DataFrame, cap: int = 3) -> DataFrame:
    """Per pattern: all URLs, kept, skipped, first and last kept, kept URLs."""
    shaped = with_pattern(requests.select("seq", "url")).where(F.col("pattern").isNotNull())
    counts = shaped.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    kept = ordered.first_n(shaped, ["pattern"], ["seq"], cap).groupBy("pattern").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("_urls"))
    return counts.join(kept, "pattern").select(
        "pattern", "total", F.least("total", F.lit(cap)).alias("kept"), F.greatest(F.col("total") - cap, F.lit(0)).alias("skipped"),
        "first_seq", "last_seq", F.transform("_urls", lambda u: u["url"]).alias("urls"))


def top_patterns(requests: DataFrame, cap: int = 3, n: int = 10) -> DataFrame:
    return pattern_counts(requests, cap).orderBy(F.desc("kept"), F.asc("first_seq")).limit(n)


def pattern_totals(requests: DataFrame, cap: int = 3) -> DataFrame:
    """Number of patterns, of patterns at the cap, and of skipped URLs."""
    counts = with_pattern(requests).where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return counts.agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("total") >= cap).alias("at_cap"),
                      F.sum(F.greatest(F.col("total") - cap, F.lit(0))).alias("skipped"))


def histogram(observations: DataFrame) -> DataFrame:
    """(name, le, bucket_count, sum, count): cumulative buckets per metric.

    All bounds are summed in one pass and unpivoted after the aggregate.
    """
    sums = observations.groupBy("name").agg(
        F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"),
        *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(HISTOGRAM_BOUNDS)])
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(HISTOGRAM_BOUNDS)]
    every = F.array(*buckets, F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return sums.select("name", F.inline(every), "sum", "count")


def counters(observations: DataFrame) -> DataFrame:
    return observations.groupBy("name", "label").agg(F.count(F.lit(1)).alias("count"))


def gauges(observations: DataFrame) -> DataFrame:
    """Last value per metric."""
    return observations.groupBy("name").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def job_states(jobs: DataFrame, states: list[str]) -> DataFrame:
    """Jobs per queue, one column per state."""
    return jobs.groupBy("queue").pivot("state", states).agg(F.count(F.lit(1))).na.fill(0)


def usage(records: DataFrame) -> DataFrame:
    return records.groupBy("user_id", "event").agg(F.sum("quantity").alias("quantity"))


def archive_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum(F.coalesce("total_size_bytes", F.lit(0))).alias("bytes"),
        F.countDistinct("page_url").alias("urls"))


def archive_size(snapshots: DataFrame) -> DataFrame:
    """Per project and over all (project NULL)."""
    return snapshots.rollup("project_id").agg(F.sum("total_size_bytes").alias("bytes"), F.count(F.lit(1)).alias("snapshots"))


def _per_project(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """Sessions and visited pages per project; visits are summed per session first."""
    pages = visits.groupBy("session_id").agg(F.count(F.lit(1)).alias("pages"))
    return (sessions.select("session_id", "project_id").join(pages, "session_id", "left").groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages")))


def project_stats(projects: DataFrame, sessions: DataFrame, visits: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions, documents and snapshots of each project."""
    docs = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"))
    joined = (projects.select("project_id", "owner").join(_per_project(sessions, visits), "project_id", "left")
              .join(docs, "project_id", "left"))
    return joined.na.fill(0, ["sessions", "pages", "documents"])


def user_usage(projects: DataFrame, sessions: DataFrame, visits: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects, sessions, pages and documents of each user."""
    return project_stats(projects, sessions, visits, documents).groupBy("owner").agg(
        F.count(F.lit(1)).alias("projects"), F.sum("sessions").alias("sessions"), F.sum("pages").alias("pages"),
        F.sum("documents").alias("documents"))


def dashboard(projects: DataFrame, sessions: DataFrame, shown: int = 10, recent: int = 4) -> DataFrame:
    """Totals over the newest ``shown`` projects and the names of the newest ``recent``."""
    newest = projects.orderBy(F.desc("project_id")).limit(shown)
    per = sessions.join(F.broadcast(newest.select("project_id")), "project_id", "left_semi").agg(
        F.coalesce(F.sum("pages_visited"), F.lit(0)).alias("pages"), F.count_if(F.col("status") == "RUNNING").alias("running"))
    names = projects.orderBy(F.desc("project_id")).limit(recent).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("project_id", "name")), asc=False), lambda p: p["name"]).alias("recent"))
    total = projects.agg(F.count(F.lit(1)).alias("projects"))
    return total.select("projects", per.select("pages").scalar().alias("pages"), per.select("running").scalar().alias("running"),
                        names.select("recent").scalar().alias("recent"))
