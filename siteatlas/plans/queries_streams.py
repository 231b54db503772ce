"""Streaming jobs, each run over the given files and checked by its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.operators import dedup
from siteatlas.plans.catalog import CTE_EVENTS, CTE_SNAPS, Tables, query
from siteatlas.plans.queries_archive import HASHED
from siteatlas.plans.queries_dedup import GREEDY
from siteatlas.plans.queries_stats import BUCKETS
from siteatlas.plans.queries_windows import STREAK
from siteatlas.session import cut_lineage, scratch_path
from siteatlas.sources import standins
from siteatlas.streaming import jobs, limits, listeners, seen, similar

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(t: Tables):
    raw = jobs.read_files(t.spark, f"{t.folder}/events*.parquet", EVENTS)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def crawl_stream(t, raw=None):
    """The crawl-event stand-in as a stream."""
    return t.spark.sql(standins.CRAWL_EVENTS, events=raw if raw is not None else event_stream(t))


def in_turns(t, rows, order: str, name: str, start, parts: int = 3, late: bool = False):
    """Let rows arrive in order, in ``parts`` turns; each turn restarts the job.

    With ``late`` the second part comes last, behind rows that follow it.

    ``start(folder)`` runs the job over the files that are new, from its
    checkpoint; the result of the last turn is returned.
    """
    folder = scratch_path(t.spark, name)
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    edges = [None, *cuts, None]
    found = None
    spans = list(zip(edges, edges[1:]))
    for low, high in [spans[0], *spans[2:], spans[1]] if late else spans:
        part = rows
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        part.write.mode("append").parquet(folder)
        found = start(folder)
    return found


def path_for(t, name: str) -> str:
    return scratch_path(t.spark, name)


@query("st_usage", """SELECT (epoch_us(ts) // 30000000) * 30000000 AS window_us, user_id, event_type AS event, count(*) AS quantity FROM events GROUP BY ALL""")
def st_usage(t):
    records = event_stream(t).select("ts", "user_id", F.col("event_type").alias("event"), F.lit(1).alias("quantity"))
    found = jobs.run_upserts(jobs.usage_windows(records), ["window_start", "user_id", "event"], path_for(t, "usage"))
    return found.select(F.unix_micros("window_start").alias("window_us"), "user_id", "event", "quantity")


@query("st_domain_rate", f"""WITH {CTE_EVENTS}, w AS (SELECT domain, (epoch_us(event_time) // 60000000 - unnest(range(5))) * 60000000 AS window_us FROM ev)
  SELECT window_us, domain, count(*) AS requests, count(*) / 5 AS per_minute FROM w GROUP BY ALL""")
def st_domain_rate(t):
    found = jobs.run_upserts(jobs.domain_rates(crawl_stream(t)), ["window_start", "domain"], path_for(t, "rates"))
    return found.select(F.unix_micros("window_start").alias("window_us"), "domain", "requests", "per_minute")


@query("st_crawl_progress", f"""WITH {CTE_EVENTS} SELECT session_id, count(*) FILTER (kind = 'success') AS visited, count(*) FILTER (kind = 'failure') AS errors,
  arg_max(error_message, seq) FILTER (kind = 'failure') AS last_error FROM ev GROUP BY session_id""")
def st_crawl_progress(t):
    return jobs.run_upserts(jobs.crawl_progress(crawl_stream(t)), ["session_id"], path_for(t, "progress"))


@query("st_session_state", f"""WITH {CTE_EVENTS} SELECT user_id AS session_id, arg_max(CASE kind WHEN 'skip' THEN 'PENDING' WHEN 'success' THEN 'RUNNING' WHEN 'failure' THEN 'FAILED' ELSE 'COMPLETED' END, (event_time, seq)) AS status
  FROM ev GROUP BY user_id""")
def st_session_state(t):
    status = (F.when(F.col("kind") == "skip", "PENDING").when(F.col("kind") == "success", "RUNNING")
              .when(F.col("kind") == "failure", "FAILED").otherwise("COMPLETED"))
    changes = crawl_stream(t).select(F.col("user_id").alias("session_id"), "event_time", status.alias("status"))
    return jobs.run_upserts(jobs.session_states(changes), ["session_id"], path_for(t, "states"))


@query("st_metrics", f"""WITH h AS (SELECT event_type AS name, round(sum(value), 2) AS sum, count(*) AS count, [{BUCKETS}, {{'le': '+Inf', 'n': count(*)}}] AS b FROM events GROUP BY 1),
  u AS (SELECT name, sum, count, unnest(b) AS x FROM h) SELECT name, x.le AS le, x.n AS bucket_count, sum, count FROM u""")
def st_metrics(t):
    """Six files, one in a micro-batch, merged after every other batch."""
    folder = path_for(t, "observed")
    t.read("events").repartition(6, "event_id").write.parquet(folder)
    observed = jobs.read_files(t.spark, folder, EVENTS, per_trigger=1).select(F.col("event_type").alias("name"), "value")
    found = jobs.run_upserts(jobs.metrics(observed), ["name", "le"], path_for(t, "metrics"), compact_every=2)
    return found.withColumn("sum", F.round("sum", 2))


@query("st_dedup", f"WITH {CTE_EVENTS} SELECT DISTINCT url AS normalized FROM ev")
def st_dedup(t):
    """Events in six files out of order, one in a micro-batch; the seen table is merged on the way."""
    folder = path_for(t, "asked")
    t.read("events").repartition(6, F.col("event_id") % 97).write.parquet(folder)
    asked = crawl_stream(t, jobs.read_files(t.spark, folder, EVENTS, per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp")))
    return seen.store_first_sightings(asked.select("seq", "url"), path_for(t, "first"), ["seq"], merge_every=2).select("normalized")


LISTENED = ", ".join(f"('{name}', '{kind}')" for kind, name in listeners.PAGE_EVENTS.items())


@query("ev_listeners", f"""WITH {CTE_EVENTS}, e AS (SELECT seq % 3 AS batch, kind FROM ev), n(event, kind) AS (VALUES {LISTENED})
  SELECT batch, event, count(*) FILTER (e.kind = n.kind) AS rows FROM e, n GROUP BY ALL
  UNION ALL SELECT batch, 'crawl:progress', count(*) FROM e GROUP BY batch UNION ALL SELECT batch, 'rows written', count(*) FROM e WHERE kind <> 'skip' GROUP BY batch
  UNION ALL SELECT b, x, CASE x WHEN 'crawl:completed' THEN 1 END FROM range(3) r(b), (VALUES ('crawl:started'), ('crawl:completed')) v(x)""")
def ev_listeners(t):
    """Three runs of a crawl stream, a batch each, with a listener on it: what it heard, beside the rows that the batches wrote."""
    folder, path, heard = path_for(t, "arriving"), path_for(t, "listened"), listeners.Listeners()
    for part in range(3):
        t.read("events").where(F.col("event_id") % 3 == part).write.mode("append").parquet(folder)
        raw = jobs.read_files(t.spark, folder, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))

        def write(batch, number):
            batch.where("kind <> 'skip'").select("seq", "kind").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

        listeners.run_listened(crawl_stream(t, raw), path, heard, write)
    events = t.spark.read.schema(listeners.EVENT_ROWS).parquet(f"{path}/events")
    runs = events.groupBy("run").agg(F.max("batch").alias("_batch"))
    told = events.join(runs, "run").select(F.coalesce("batch", "_batch").alias("batch"), "event", "rows")
    written = t.spark.read.parquet(f"{path}/rows").groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("rows"))
    return told.unionByName(written.select("batch", F.lit("rows written").alias("event"), "rows"))


@query("st_block", f"""WITH {STREAK}, b AS (SELECT *, count(*) FILTER (kind = 'challenge') OVER (PARTITION BY domain ORDER BY seq) AS challenges,
  contains(error_message, '429') OR contains(lower(error_message), 'rate limit') AS l FROM g)
  SELECT seq, domain, streak, challenges, CAST(CASE WHEN streak >= 2 THEN least(16, pow(2, streak - 1)) ELSE 1 END AS DOUBLE) AS multiplier,
  CASE WHEN kind = 'failure' AND streak >= 2 THEN CASE WHEN l THEN 'rate-limited' ELSE 'consecutive-failures' END WHEN kind = 'challenge' AND challenges >= 2 THEN 'challenge-flood' END AS reason,
  CASE WHEN kind = 'failure' AND streak >= 2 THEN CASE WHEN l THEN 'back-off' ELSE 'rotate-proxy' END WHEN kind = 'challenge' AND challenges >= 2 THEN 'rotate-proxy' END AS recommended_action FROM b""")
def st_block(t):
    path = path_for(t, "blocks")

    def start(folder):
        raw = jobs.read_files(t.spark, folder, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        return jobs.store_block_signals(crawl_stream(t, raw), path, 2, chunk_rows=1000)

    return in_turns(t, t.read("events"), "event_id", "events", start)


@query("st_similarity", f"WITH {GREEDY} SELECT fp.seq, k.seq IS NOT NULL AS kept FROM fp LEFT JOIN chosen k ON k.seq = fp.seq")
def st_similarity(t):
    prints = dedup.fingerprints(t.rich_pages).select(
        "seq", F.lit("all").alias("site"), "title", F.col("links").cast("bigint").alias("links"),
        F.col("forms").cast("bigint").alias("forms"), F.col("length").cast("bigint").alias("length"))
    path = path_for(t, "similar")

    def start(folder):
        return similar.store_similarity(jobs.read_files(t.spark, folder, prints.schema), path)

    found = in_turns(t, cut_lineage(prints, "prints"), "seq", "prints", start)
    return found.select("seq", (F.col("decision") == "kept").alias("kept"))


@query("st_rate_limit", """WITH RECURSIVE e AS (SELECT event_id AS seq, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT seq, user_id, n, ms, 3::DOUBLE AS before FROM e WHERE n = 1
  UNION ALL SELECT e.seq, e.user_id, e.n, e.ms, CASE WHEN e.ms - r.ms > 43200000 THEN 3::DOUBLE ELSE least(3::DOUBLE, (r.before - CASE WHEN r.before >= 1 THEN 1 ELSE 0 END) + (e.ms - r.ms) * (3 / 86400000::DOUBLE)) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT seq, before >= 1 AS allowed, CAST(floor(before - CASE WHEN before >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS remaining FROM r""")
def st_rate_limit(t):
    path = path_for(t, "limits")

    def start(folder):
        asked = jobs.read_files(t.spark, folder, EVENTS).select(
            F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"))
        return limits.store_rate_limits(asked, path, 3, 86_400_000, idle_ms=43_200_000, chunk_rows=1000)

    return in_turns(t, t.read("events"), "event_id", "requests", start)


@query("st_snapshots", f"""WITH {CTE_SNAPS}, {HASHED} SELECT snapshot_id, lag(snapshot_id) OVER w AS previous_snapshot_id, lag(content_hash) OVER w AS previous_content_hash
  FROM h WINDOW w AS (PARTITION BY page_url_hash ORDER BY captured_us, seq)""")
def st_snapshots(t):
    pages = t.snapshots.select("seq", "snapshot_id", "captured_at", "page_url", "html")
    path = path_for(t, "history")

    def start(folder):
        return jobs.store_with_previous(jobs.snapshot_stream(jobs.read_files(t.spark, folder, pages.schema)), path, merge_every=2)

    return in_turns(t, pages, "seq", "captured", start, late=True).select("snapshot_id", "previous_snapshot_id", "previous_content_hash")


@query("st_ckpt", "SELECT user_id AS session_id, count(*) AS handled FROM events GROUP BY 1")
def st_ckpt(t):
    """Stop after the first half, restart from the checkpoint with the rest."""
    path = path_for(t, "resumed")

    def start(folder):
        stream = jobs.read_files(t.spark, folder, EVENTS)
        counted = stream.groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("handled"))
        return jobs.run_upserts(counted, ["session_id"], path)

    return in_turns(t, t.read("events"), "event_id", "arriving", start, parts=2)
