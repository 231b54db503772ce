"""Snapshot history over the documents stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import archive
from siteatlas.plans.catalog import CTE_SNAPS, Tables, query
from siteatlas.plans.queries_stats import SIZED, sized

HASH = ("substr(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(page_url), '^https?://', ''), "
        "'^www\\.', ''), '#.*$', ''), '/$', '')), 1, 16)")
HASHED = f"""h AS (SELECT seq, snapshot_id, project_id, page_url, captured_us, http_status, {HASH} AS page_url_hash, substr(sha256(html), 1, 16) AS content_hash,
  substr(sha256(CASE WHEN seq % 3 = 0 THEN substr(to_base64(encode(lang)), 1, 10000) ELSE html END), 1, 16) AS visual_hash,
  octet_length(encode(html)) + CASE WHEN seq % 3 = 0 THEN octet_length(encode(lang)) ELSE 0 END AS total_size_bytes FROM snaps)"""


def captured(t: Tables):
    shot = F.when(F.col("seq") % 3 == 0, F.encode("lang", "utf-8"))
    return archive.snapshot_rows(t.snapshots.withColumn("screenshot", shot))


@query("sink_snapshot", f"WITH {CTE_SNAPS}, {HASHED} SELECT snapshot_id, page_url_hash, content_hash, visual_hash, total_size_bytes FROM h")
def sink_snapshot(t):
    from siteatlas.sources import archive as files

    stored = files.store_snapshots(captured(t), files.scratch(t.spark, "snapshots"))
    return stored.select("snapshot_id", "page_url_hash", "content_hash", "visual_hash", "total_size_bytes")


@query("src_timeline", f"""WITH {CTE_SNAPS} SELECT snapshot_id, captured_us FROM snaps WHERE page_url = 'https://src7.example.com/d/7' ORDER BY captured_us""")
def src_timeline(t):
    rows = t.snapshots.withColumn("page_url_hash", U.url_hash(F.col("page_url")))
    return archive.timeline(rows, "https://src7.example.com/d/7").select("snapshot_id", "captured_us")


@query("src_archive", f"""WITH {CTE_SNAPS} SELECT snapshot_id, project_id, page_url FROM snaps WHERE project_id = 'src3' ORDER BY captured_us DESC""")
def src_archive(t):
    """Metadata files of one project, with unreadable ones among them."""
    from siteatlas.sources import archive as files

    folder = files.scratch(t.spark, "metadata")
    files.write_metadata(captured(t), folder)
    return files.read_metadata(t.spark, folder, "src3").select("snapshot_id", "project_id", "page_url")


@query("scan_list", """SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status,
  epoch_us(o_orderdate) AS started_us FROM orders WHERE o_custkey = 77 ORDER BY o_orderdate DESC""")
def scan_list(t):
    from siteatlas.plans.queries_stats import sessions

    mine = sessions(t).where(F.col("project_id") == 77).orderBy(F.desc("started_at"))
    return mine.select("session_id", "status", F.unix_micros("started_at").alias("started_us"))


@query("win_change", f"""WITH {CTE_SNAPS}, {HASHED}, l AS (SELECT *, lag(snapshot_id) OVER w AS previous_snapshot_id, lag(content_hash) OVER w AS pc, lag(visual_hash) OVER w AS pv,
  lag(http_status) OVER w AS ps, lag(captured_us) OVER w AS pt FROM h WINDOW w AS (PARTITION BY page_url_hash ORDER BY captured_us, seq))
  SELECT snapshot_id, previous_snapshot_id, content_hash <> pc AS text_changed, visual_hash <> pv AS visual_changed, http_status <> ps AS status_changed,
  (captured_us - pt) / 1000000 AS seconds_since FROM l""")
def win_change(t):
    return archive.change_history(captured(t)).select(
        "snapshot_id", "previous_snapshot_id", "text_changed", "visual_changed", "status_changed", "seconds_since")


@query("cmp_snapshots", f"""WITH {CTE_SNAPS}, {HASHED} SELECT a.snapshot_id AS first_id, b.snapshot_id AS second_id, a.content_hash <> b.content_hash AS text_changed,
  a.visual_hash <> b.visual_hash AS visual_changed, CASE WHEN a.content_hash <> b.content_hash THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS text_similarity,
  CASE WHEN a.visual_hash <> b.visual_hash THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS visual_similarity, a.http_status <> b.http_status AS status_changed,
  abs(b.captured_us - a.captured_us) / 1000 AS time_difference_ms FROM h a JOIN h b ON b.seq = a.seq + 100""")
def cmp_snapshots(t):
    rows = captured(t)
    pairs = rows.select(F.col("snapshot_id").alias("first_id"), F.concat(F.lit("snap"), F.col("seq") + 100).alias("second_id"))
    return archive.compare(pairs, rows)


@query("win_latest", f"""WITH {CTE_SNAPS}, {HASHED} SELECT page_url_hash, snapshot_id, content_hash FROM h
  QUALIFY row_number() OVER (PARTITION BY page_url_hash ORDER BY captured_us DESC, seq DESC) = 1""")
def win_latest(t):
    return archive.latest_fields(captured(t), ["captured_at", "seq"], ["snapshot_id", "content_hash"], "page_url_hash")


def stored_days(t):
    """The snapshots' sizes as a store by day."""
    from siteatlas.sources import archive as files

    folder = files.scratch(t.spark, "days")
    files.store_days(sized(t).select("snapshot_id", "seq", "captured_at", "total_size_bytes"), folder)
    return files, folder


@query("win_ttl", f"""WITH {CTE_SNAPS}, z AS ({SIZED}), m AS (SELECT CAST(1704067200000000 + (SELECT max(doc_id) FROM documents) * 60000000 // 2 AS BIGINT) AS us),
  d AS (SELECT strftime(make_timestamp(captured_us), '%Y-%m-%d') AS day, captured_us < us AS gone, total_size_bytes FROM z, m)
  SELECT day, count(*) FILTER (gone) AS deleted_snapshots, CAST(coalesce(sum(total_size_bytes) FILTER (gone), 0) AS BIGINT) AS freed_bytes,
  count(*) FILTER (NOT gone) AS left_snapshots FROM d GROUP BY day""")
def win_ttl(t):
    """What was deleted and what the store still holds, by day."""
    files, folder = stored_days(t)
    newest = t.read("documents").agg(F.max("doc_id")).scalar()
    middle = (F.lit(1704067200000000) + F.floor(newest * 60000000 / 2)).cast("bigint")
    # The clock stands one day after the middle of the covered time.
    middle = t.spark.range(1).select(F.timestamp_micros(middle + 86_400_000_000).alias("now")).first()["now"]
    report = files.expire(t.spark, folder, F.lit(middle), 1)
    left = files.read_days(t.spark, folder).groupBy("day").agg(F.count(F.lit(1)).alias("left_snapshots"))
    zero = F.lit(0).cast("bigint")
    return report.join(left, "day", "full").select("day", *[F.coalesce(c, zero).alias(c) for c in (
        "deleted_snapshots", "freed_bytes", "left_snapshots")])


@query("win_quota", f"""WITH {CTE_SNAPS}, z AS ({SIZED}), r AS (SELECT snapshot_id, total_size_bytes, sum(total_size_bytes) OVER (ORDER BY captured_us, seq) - total_size_bytes AS before,
  sum(total_size_bytes) OVER () AS total FROM z) SELECT snapshot_id, total_size_bytes FROM r WHERE total - before <= 1500000""")
def win_quota(t):
    """What is left in the store once it fits."""
    files, folder = stored_days(t)
    files.fit_quota(t.spark, folder, 1_500_000)
    return files.read_days(t.spark, folder).select("snapshot_id", "total_size_bytes")


@query("win_quota_report", f"""WITH {CTE_SNAPS}, z AS ({SIZED}), r AS (SELECT snapshot_id, total_size_bytes, sum(total_size_bytes) OVER (ORDER BY captured_us, seq) - total_size_bytes AS before,
  sum(total_size_bytes) OVER () AS total FROM z) SELECT snapshot_id, total_size_bytes FROM r WHERE total - before > 1500000""")
def win_quota_report(t):
    """What the quota would delete."""
    return archive.over_quota(sized(t), 1_500_000).select("snapshot_id", "total_size_bytes")


@query("an_pending", f"""WITH {CTE_SNAPS} SELECT snapshot_id FROM snaps WHERE seq NOT IN (SELECT doc_id FROM labels)""")
def an_pending(t):
    done = t.read("labels").select(F.col("doc_id").alias("seq"), F.lit("{}").alias("analysis_json"))
    return archive.pending_analysis(t.snapshots.join(done, "seq", "left")).select("snapshot_id")
