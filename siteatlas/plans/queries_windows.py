"""Order-dependent jobs: caps, schedules, streaks, pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.operators import blocks, frontier, ordered, stats
from siteatlas.plans.catalog import CTE_EVENTS, Tables, query
from siteatlas.plans.queries_stats import PATTERN, projects

# Small chunks, so the given tables cross many chunk borders.
ROWS = 64


def requests(t: Tables):
    return t.pages.select(F.col("page_id").alias("seq"), "url")


@query("win_pattern_cap", f"""WITH p AS (SELECT page_id AS seq, url, {PATTERN} AS pattern FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY seq) AS n FROM p)
  SELECT seq, pattern, n <= 3 AS kept, CASE WHEN n > 3 THEN 'Pattern ''' || pattern || ''' already crawled 3 times. Skipping repetitive URL.' END AS reason FROM r""")
def win_pattern_cap(t):
    return stats.pattern_cap(requests(t)).select("seq", "pattern", "kept", "reason")


@query("win_pagination_cap", f"""WITH {CTE_EVENTS}, r AS (SELECT seq, url || '/page/' || (seq % 40) AS url FROM ev), p AS (SELECT *, regexp_replace(url, '[0-9]+', ':n', 'g') AS pattern FROM r)
  SELECT seq, row_number() OVER (PARTITION BY pattern ORDER BY seq) <= 10 AS kept FROM p""")
def win_pagination_cap(t):
    rows = t.crawl_events.select("seq", F.concat("url", F.lit("/page/"), (F.col("seq") % 40).cast("string")).alias("url"))
    return frontier.pagination_cap(rows, ["seq"]).select("seq", "kept")


@query("win_domain_slots", f"""WITH {CTE_EVENTS} SELECT seq, domain, row_number() OVER (PARTITION BY domain ORDER BY priority, seq) AS slot FROM ev
  QUALIFY slot <= 2""")
def win_domain_slots(t):
    rows = ordered.first_n(t.crawl_events.select("seq", "domain", "priority"), ["domain"], ["priority", "seq"], 2)
    return rows.select("seq", "domain", F.col("rank").cast("bigint").alias("slot"))


@query("win_domain_schedule", f"""WITH {CTE_EVENTS}, s AS (SELECT *, sum(CASE WHEN kind = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY seq) AS f FROM ev),
  g AS (SELECT *, f - coalesce(max(CASE WHEN kind = 'success' THEN f END) OVER (PARTITION BY domain ORDER BY seq), 0) AS streak FROM s),
  h AS (SELECT domain, arg_max(streak, seq) AS streak FROM g GROUP BY domain), m AS (SELECT domain, CASE WHEN streak >= 2 THEN least(16, pow(2, streak - 1)) ELSE 1 END AS m FROM h)
  SELECT seq, ev.domain, CAST((row_number() OVER (PARTITION BY ev.domain ORDER BY priority, seq) - 1) * 1000 * m AS DOUBLE) AS start_ms FROM ev JOIN m USING (domain)""")
def win_domain_schedule(t):
    events = t.crawl_events
    health = blocks.domain_health(events, 2)
    return frontier.schedule(events.select("seq", "domain", "priority"), health, 1000, rows=ROWS).select("seq", "domain", "start_ms")


STREAK = f"""{CTE_EVENTS}, s AS (SELECT *, sum(CASE WHEN kind = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY seq) AS f FROM ev),
  g AS (SELECT *, CAST(f - coalesce(max(CASE WHEN kind = 'success' THEN f END) OVER (PARTITION BY domain ORDER BY seq), 0) AS BIGINT) AS streak FROM s)"""


@query("win_failure_streak", f"""WITH {STREAK} SELECT seq, domain, streak AS consecutive_count, CASE WHEN l THEN 'rate-limited' ELSE 'consecutive-failures' END AS reason,
  CASE WHEN l THEN 'back-off' ELSE 'rotate-proxy' END AS recommended_action FROM (SELECT *, contains(error_message, '429') OR contains(lower(error_message), 'rate limit') AS l FROM g)
  WHERE kind = 'failure' AND streak >= 2""")
def win_failure_streak(t):
    return blocks.failure_signals(t.crawl_events, 2, ROWS)


@query("win_challenge_count", f"""WITH {CTE_EVENTS} SELECT seq, domain, count(*) OVER (PARTITION BY domain ORDER BY seq) AS challenges,
  CASE WHEN count(*) OVER (PARTITION BY domain ORDER BY seq) >= 5 THEN 'challenge-flood' END AS reason FROM ev WHERE kind = 'challenge'""")
def win_challenge_count(t):
    return blocks.challenge_counts(t.crawl_events, 5, ROWS)


@query("win_delay_multiplier", f"WITH {STREAK} SELECT seq, domain, CAST(CASE WHEN streak >= 2 THEN least(16, pow(2, streak - 1)) ELSE 1 END AS DOUBLE) AS multiplier FROM g")
def win_delay_multiplier(t):
    return blocks.delay_multipliers(t.crawl_events, 2, ROWS).select("seq", "domain", "multiplier")


@query("win_blocked_domains", f"""WITH {STREAK}, d AS (SELECT domain, arg_max(streak, seq) AS failures, count(*) FILTER (kind = 'challenge') AS challenges FROM g GROUP BY domain)
  SELECT domain, failures, challenges, failures >= 2 OR challenges >= 2 AS blocked FROM d""")
def win_blocked_domains(t):
    return blocks.domain_health(t.crawl_events, 2).select("domain", "failures", "challenges", "blocked")


@query("win_error_budget", f"""WITH {CTE_EVENTS}, b AS (SELECT *, sum(CASE WHEN kind = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq)
  - CASE WHEN kind = 'failure' THEN 1 ELSE 0 END AS before FROM ev) SELECT seq, session_id FROM b WHERE before < 20""")
def win_error_budget(t):
    return blocks.within_error_budget(t.crawl_events, 20, ROWS).select("seq", "session_id")


@query("ord_page", """SELECT c_custkey AS project_id, c_name AS name, CAST(ceil((SELECT count(*) FROM customer) / 20.0) AS BIGINT) AS total_pages
  FROM customer ORDER BY c_custkey DESC LIMIT 20 OFFSET 40""")
def ord_page(t):
    return frontier.result_page(projects(t).select("project_id", "name"), [F.desc("project_id")], page=3, size=20)


@query("ord_priority", f"WITH {CTE_EVENTS} SELECT seq, url, priority FROM ev ORDER BY priority, seq LIMIT 25")
def ord_priority(t):
    return t.crawl_events.select("seq", "url", "priority").orderBy("priority", "seq").limit(25)


@query("ord_search_projects", """SELECT c_custkey AS project_id, c_name AS name FROM customer
  WHERE contains(lower(c_name), '00012') OR contains('https://' || lower(c_mktsegment) || '.example.com', '00012') OR contains('https://' || lower(c_mktsegment) || '.example.com', 'machi')""")
def ord_search_projects(t):
    rows = projects(t)
    return frontier.search_projects(rows, "00012").unionByName(frontier.search_projects(rows, "MACHI")).distinct().select("project_id", "name")
