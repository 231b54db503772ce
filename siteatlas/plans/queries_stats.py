"""Aggregations over crawl events, archives and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import stats
from siteatlas.plans.catalog import CTE_EVENTS, CTE_SNAPS, Tables, query


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("agg_crawl_stats", f"""WITH {CTE_EVENTS}, s AS (SELECT session_id, count(*) FILTER (kind = 'success') AS success_count,
  count(*) FILTER (kind = 'failure') AS failed_count, count(*) FILTER (kind = 'skip') AS skipped_count, CAST(0 AS BIGINT) AS retry_count,
  CAST(floor(avg(duration_ms) FILTER (kind = 'success') + 0.5) AS BIGINT) AS avg_processing_ms, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000 AS elapsed_ms
  FROM ev GROUP BY session_id), e AS (SELECT session_id, error_type || ': ' || substr(error_message, 1, 100) AS error_key, count(*) AS errors
  FROM ev WHERE kind = 'failure' GROUP BY ALL) SELECT s.*, success_count + failed_count + skipped_count AS total_requests,
  floor((success_count + failed_count + skipped_count) / (elapsed_ms / 60000) * 10 + 0.5::DOUBLE) / 10 AS requests_per_minute, error_key, errors FROM s JOIN e USING (session_id)""")
def agg_crawl_stats(t: Tables):
    base = longs(stats.crawl_stats(t.crawl_events), "avg_processing_ms")
    return base.join(stats.errors_by_type(t.crawl_events), "session_id")


@query("agg_domain_stats", f"""WITH {CTE_EVENTS} SELECT domain, count(*) FILTER (kind = 'success') AS success_count, count(*) FILTER (kind = 'failure') AS failed_count,
  CAST(floor(coalesce(avg(duration_ms) FILTER (kind = 'success'), 0) + 0.5) AS BIGINT) AS avg_load_ms, count(*) FILTER (kind = 'challenge') AS challenge_count
  FROM ev GROUP BY domain HAVING count(*) FILTER (kind IN ('success', 'failure')) > 0""")
def agg_domain_stats(t):
    return longs(stats.domain_stats(t.crawl_events), "avg_load_ms")


@query("agg_summary", f"""WITH {CTE_EVENTS}, s AS (SELECT session_id, count(DISTINCT url) FILTER (kind IN ('success', 'failure')) AS visited,
  (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000 AS s FROM ev GROUP BY session_id)
  SELECT session_id, visited, visited / greatest(1::DOUBLE, s) AS pages_per_second FROM s""")
def agg_summary(t):
    return stats.crawl_summary(t.crawl_events)


@query("agg_errors", f"""WITH {CTE_EVENTS}, f AS (SELECT *, error_type || ': ' || substr(error_message, 1, 100) AS error_key FROM ev WHERE kind = 'failure'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 1000)
  SELECT session_id, error_key, count(*) AS errors, array_to_string(list(url ORDER BY seq)[1:5], ' ') AS urls, epoch_us(max(event_time)) AS last_seen_us FROM f GROUP BY ALL""")
def agg_errors(t):
    return stats.grouped_errors(t.crawl_events).select(
        "session_id", "error_key", "errors", F.array_join("urls", " ").alias("urls"), F.unix_micros("last_seen").alias("last_seen_us"))


@query("ord_recent_errors", f"WITH {CTE_EVENTS} SELECT seq, url, error_type, error_message FROM ev WHERE kind = 'failure' ORDER BY seq DESC LIMIT 10")
def ord_recent_errors(t):
    return stats.recent_errors(t.crawl_events).select("seq", "url", "error_type", "error_message")


# The given URLs are plain: scheme, host, path and at most two parameters.
PATTERN = """(regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '/[0-9]+', '/:id', 'g')
  || regexp_replace(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '=[0-9]+(&|$)', '=:num\\1', 'g'))"""


@query("agg_patterns", f"""WITH p AS (SELECT page_id AS seq, url, {PATTERN} AS pattern FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY seq) AS n, count(*) OVER (PARTITION BY pattern) AS total FROM p)
  SELECT pattern, max(total) AS total, least(max(total), 3) AS kept, greatest(max(total) - 3, 0) AS skipped, min(seq) AS first_seq, max(seq) AS last_seq,
  array_to_string(list(url ORDER BY seq), ' ') AS urls FROM r WHERE n <= 3 GROUP BY pattern ORDER BY kept DESC, first_seq LIMIT 10""")
def agg_patterns(t):
    top = stats.top_patterns(t.pages.select(F.col("page_id").alias("seq"), "url"))
    return longs(top.withColumn("urls", F.array_join("urls", " ")), "kept", "skipped")


@query("agg_pattern_totals", f"""WITH p AS (SELECT {PATTERN} AS pattern FROM pages), c AS (SELECT pattern, count(*) AS total FROM p GROUP BY pattern)
  SELECT count(*) AS patterns, count(*) FILTER (total >= 3) AS at_cap, CAST(sum(greatest(total - 3, 0)) AS BIGINT) AS skipped FROM c""")
def agg_pattern_totals(t):
    return stats.pattern_totals(t.pages.select(F.col("page_id").alias("seq"), "url"))


SIZED = "SELECT *, octet_length(encode(html)) AS total_size_bytes FROM snaps"


def sized(t):
    return t.snapshots.withColumn("total_size_bytes", F.octet_length("html").cast("bigint"))


@query("agg_archive_stats", f"""WITH {CTE_SNAPS}, z AS ({SIZED}) SELECT project_id, count(*) AS snapshots, CAST(sum(total_size_bytes) AS BIGINT) AS bytes,
  count(DISTINCT page_url) AS urls FROM z GROUP BY project_id""")
def agg_archive_stats(t):
    return stats.archive_stats(sized(t))


@query("agg_archive_size", f"""WITH {CTE_SNAPS}, z AS ({SIZED}) SELECT coalesce(project_id, 'all') AS project, CAST(sum(total_size_bytes) AS BIGINT) AS bytes, count(*) AS snapshots
  FROM z GROUP BY ROLLUP (project_id)""")
def agg_archive_size(t):
    return stats.archive_size(sized(t)).select(F.coalesce("project_id", F.lit("all")).alias("project"), "bytes", "snapshots")


def projects(t):
    return t.read("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("bigint").alias("owner"),
                                     F.col("c_name").alias("name"), F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("base_url"))


def sessions(t):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
    return t.read("orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("project_id"), status.alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("pages_visited"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderpriority").alias("queue"))


def visits(t):
    return t.read("lineitem").select(F.col("l_orderkey").alias("session_id"))


def project_documents(t):
    return t.read("documents").select((F.col("doc_id") % 500).alias("project_id"))


PER_PROJECT = """d AS (SELECT doc_id % 500 AS project_id, count(*) AS documents FROM documents GROUP BY 1),
  v AS (SELECT o_custkey AS project_id, count(DISTINCT o_orderkey) AS sessions, count(l_orderkey) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
  p AS (SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS owner, coalesce(sessions, 0) AS sessions, coalesce(pages, 0) AS pages, coalesce(documents, 0) AS documents
  FROM customer LEFT JOIN v ON v.project_id = c_custkey LEFT JOIN d ON d.project_id = c_custkey)"""


@query("agg_project_stats", f"WITH {PER_PROJECT} SELECT * FROM p")
def agg_project_stats(t):
    return stats.project_stats(projects(t), sessions(t), visits(t), project_documents(t))


@query("agg_user_usage", f"""WITH {PER_PROJECT} SELECT owner, count(*) AS projects, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(pages) AS BIGINT) AS pages,
  CAST(sum(documents) AS BIGINT) AS documents FROM p GROUP BY owner""")
def agg_user_usage(t):
    return stats.user_usage(projects(t), sessions(t), visits(t), project_documents(t))


@query("agg_usage_events", "SELECT user_id, event_type AS event, count(*) AS quantity FROM events GROUP BY ALL")
def agg_usage_events(t):
    return stats.usage(t.events.select("user_id", F.col("event_type").alias("event"), F.lit(1).alias("quantity")))


@query("agg_dashboard", """WITH n AS (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 10) SELECT (SELECT count(*) FROM customer) AS projects,
  CAST(sum(floor(o_totalprice)) AS BIGINT) AS pages, count(*) FILTER (o_orderstatus = 'O') AS running,
  (SELECT string_agg(c_name, ',' ORDER BY c_custkey DESC) FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 4)) AS recent
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM n)""")
def agg_dashboard(t):
    return stats.dashboard(projects(t), sessions(t)).withColumn("recent", F.array_join("recent", ","))


@query("agg_analysis_progress", f"""WITH {CTE_SNAPS} SELECT project_id, count(*) AS total, count(labels.doc_id) AS analyzed FROM snaps
  LEFT JOIN labels ON labels.doc_id = seq GROUP BY project_id""")
def agg_analysis_progress(t):
    done = t.read("labels").select(F.col("doc_id").alias("seq"), F.lit(True).alias("analysis"))
    return t.snapshots.join(done, "seq", "left").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("analysis").alias("analyzed"))


BUCKETS = ", ".join(f"{{'le': '{b}', 'n': count(*) FILTER (value <= {b})}}" for b in stats.HISTOGRAM_BOUNDS)


@query("agg_histogram", f"""WITH h AS (SELECT event_type AS name, round(sum(value), 2) AS sum, count(*) AS count, [{BUCKETS}, {{'le': '+Inf', 'n': count(*)}}] AS b FROM events GROUP BY 1),
  u AS (SELECT name, sum, count, unnest(b) AS x FROM h) SELECT name, x.le AS le, x.n AS bucket_count, sum, count FROM u""")
def agg_histogram(t):
    return stats.histogram(t.events.select(F.col("event_type").alias("name"), "value")).withColumn("sum", F.round("sum", 2))


@query("agg_counters", "SELECT event_type AS name, CAST(user_id % 5 AS VARCHAR) AS label, count(*) AS count FROM events GROUP BY ALL")
def agg_counters(t):
    return stats.counters(t.events.select(F.col("event_type").alias("name"), (F.col("user_id") % 5).cast("string").alias("label")))


@query("agg_gauges", "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def agg_gauges(t):
    return stats.gauges(t.events.select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq")))


@query("agg_job_states", """SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O') AS running,
  count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1""")
def agg_job_states(t):
    wide = stats.job_states(sessions(t).select("queue", F.col("status").alias("state")), ["PENDING", "RUNNING", "COMPLETED"])
    return wide.select("queue", *[F.col(c).alias(c.lower()) for c in ("PENDING", "RUNNING", "COMPLETED")])


@query("agg_audit", "SELECT event_type AS action, user_id, count(*) AS entries, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL")
def agg_audit(t):
    return t.events.groupBy(F.col("event_type").alias("action"), "user_id").agg(
        F.count(F.lit(1)).alias("entries"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("agg_audit_recent", "SELECT event_id, event_type AS action, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def agg_audit_recent(t):
    return t.events.orderBy(F.desc("event_id")).limit(50).select("event_id", F.col("event_type").alias("action"), "user_id")


REDIRECTS = """red AS (SELECT seq, url AS start, concat('https://site', CAST((user_id + seq) % 20 AS STRING), '.example.com/p/', CAST((seq * 3) % 50 AS STRING)) AS final
  FROM ev WHERE (kind = 'success'))"""


def redirects(t):
    final = F.concat(F.lit("https://site"), ((F.col("user_id") + F.col("seq")) % 20).cast("string"), F.lit(".example.com/p/"),
                     ((F.col("seq") * 3) % 50).cast("string"))
    return t.crawl_events.where("kind = 'success'").select("seq", F.col("url").alias("start"), final.alias("final"))


@query("agg_redirects", f"""WITH {CTE_EVENTS}, {REDIRECTS} SELECT start, row_number() OVER (PARTITION BY start ORDER BY seq) AS hop, final,
  count(*) OVER (PARTITION BY start) AS hops FROM red WHERE start <> final""")
def agg_redirects(t):
    from siteatlas.operators import frontier
    return frontier.redirect_chains(redirects(t))
