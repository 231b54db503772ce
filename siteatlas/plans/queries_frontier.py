"""Frontier planning over the given pages and crawl events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import frontier
from siteatlas.plans.catalog import CTE_EVENTS, CTE_LINKS, Tables, query
from siteatlas.plans.queries_dedup import NORMALIZED, requests
from siteatlas.plans.queries_extract import BASE, BPATH, LINKS
from siteatlas.plans.queries_stats import REDIRECTS, redirects
from siteatlas.sources import robots

FOUND = f"""{LINKS}, few AS (SELECT p.page_id, p.url, page_id % 9 = 4 OR (SELECT count(*) FROM out_links o WHERE o.page_id = p.page_id) < 3 AS few FROM pages p),
cand AS (SELECT page_id AS seq, href AS url, 'link' AS origin, 10 AS priority, 1 AS depth FROM out_links
  UNION ALL SELECT page_id, unnest([{BASE} || '/dr/' || (page_id % 6), {BASE} || '/#/r/' || (page_id % 9), {BASE} || '/#!/s']), 'route', 5, 1 FROM few WHERE few AND page_id % 7 = 0
  UNION ALL SELECT page_id, unnest([{BASE} || {BPATH} || '#/r/' || (page_id % 9), {BASE} || {BPATH} || '#!/s', {BASE} || '/route-' || (page_id % 5), {BASE} || '/route/b']), 'hash', 8, 1 FROM pages WHERE page_id % 7 = 0
  UNION ALL SELECT page_id, {BASE} || '/search/' || (page_id % 11) || '?q=test&sort=new', 'form', 7, 1 FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {BASE} || {BPATH} || '?page=' || (page_id % 7 + 1) ELSE {BASE} || '/p/3' END, 'pagination', 15, 0 FROM pages WHERE page_id % 2 = 0 OR page_id % 8 = 3)"""


@query("fr_candidates", f"WITH {FOUND} SELECT seq, url, origin, CAST(priority AS BIGINT) AS priority, CAST(depth AS BIGINT) AS depth FROM cand")
def fr_candidates(t: Tables):
    found = frontier.candidates(t.rich_pages.withColumn("depth", F.lit(0)))
    return found.select("seq", "url", "origin", F.col("priority").cast("bigint").alias("priority"), F.col("depth").cast("bigint").alias("depth"))


SCOPE = U.Scope("https://example.com/docs", "full", exclude=("/javascript/",))
ROBOT_BODY = "concat('User-agent: *', chr(10), 'Disallow: /docs/a', chr(10), 'Allow: /docs/a3', chr(10), 'Disallow: /files') AS body"


def checked(t):
    """Queued URL shapes against the pages visited, robots, loops and blocked domains."""
    queue = requests(t).withColumn("priority", (F.col("seq") % 4).cast("int"))
    visited = t.pages.where("page_id % 3 = 0").select("url")
    rules = robots.robots_rules(queue.select(U.hostname(F.col("url")).alias("host")).where("host <> ''").distinct().selectExpr("host", ROBOT_BODY))
    loops = queue.where("page_id % 10 = 1").select("url").distinct()
    health = queue.select(U.hostname(F.col("url")).alias("domain")).distinct().withColumn("blocked", F.col("domain") == "cdn.example.com")
    # Files of the blocked host are let through by robots for every other page.
    return frontier.preflight(queue, visited, SCOPE, rules, loops, health, 10)


NPATH = "coalesce(nullif(regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1), ''), '/')"
CHECKED = f"""{NORMALIZED}, q AS (SELECT n.seq, n.page_id, n.url, CAST(n.seq % 4 AS INT) AS priority, p.http, p.scheme, p.path, p.search, p.hostname
  FROM norm n JOIN parts p ON p.page_id * 16 + p.k = n.seq WHERE n.normalized NOT IN (SELECT normalized FROM norm WHERE page_id % 3 = 0 AND seq % 16 = 0)),
lp AS (SELECT DISTINCT url FROM norm WHERE page_id % 10 = 1),
e AS (SELECT q.*, CASE WHEN NOT http OR contains(url, 'javascript') THEN 'navigation strategy'
    WHEN http AND ((starts_with(path, '/docs/a') AND NOT starts_with(path, '/docs/a3')) OR starts_with(path, '/files')) THEN 'disallowed by robots.txt'
    WHEN url IN (SELECT url FROM lp) THEN 'redirect loop detected' END AS early FROM q),
c AS (SELECT *, CASE WHEN early IS NULL AND http AND (regexp_matches(lower(path), '/page/[0-9]+|/p/[0-9]+') OR regexp_matches(lower(search), '[?&](page|p|pg|offset|start|skip|from|cursor)=[0-9]+'))
  THEN regexp_replace(url, '[0-9]+', ':n', 'g') END AS pat FROM e),
ck AS (SELECT seq, url, priority, hostname, coalesce(early, CASE WHEN pat IS NOT NULL AND row_number() OVER (PARTITION BY pat ORDER BY priority, seq) > 10 THEN 'pagination cap (10)' END,
  CASE WHEN hostname = 'cdn.example.com' THEN 'domain blocked' END) AS skip_reason FROM c)"""


@query("fr_preflight", f"WITH {CHECKED} SELECT seq, skip_reason FROM ck")
def fr_preflight(t):
    return checked(t).select("seq", "skip_reason")


@query("fr_skip_report", f"WITH {CHECKED} SELECT skip_reason, count(*) AS skipped FROM ck WHERE skip_reason IS NOT NULL GROUP BY 1")
def fr_skip_report(t):
    return frontier.skip_report(checked(t))


@query("fr_next_round", f"""WITH {CHECKED}, s AS (SELECT * FROM ck WHERE skip_reason IS NULL QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY priority, seq) <= 3)
  SELECT seq, url, CAST(priority AS BIGINT) AS priority FROM s ORDER BY priority, seq LIMIT 40""")
def fr_next_round(t):
    return frontier.next_round(checked(t), 3, 40).select("seq", "url", F.col("priority").cast("bigint").alias("priority"))


@query("fr_retry", f"""WITH {CTE_EVENTS}, f AS (SELECT *, retry_count < 2 AND NOT regexp_matches(lower(error_message), 'net::err_aborted|invalid url|protocol error') AS again FROM ev WHERE kind = 'failure')
  SELECT seq, again AS will_retry, CAST(CASE WHEN again THEN retry_count + 1 ELSE retry_count END AS BIGINT) AS retry_count, CAST(CASE WHEN again THEN priority + 5 ELSE priority END AS BIGINT) AS priority FROM f""")
def fr_retry(t):
    out = frontier.retries(t.crawl_events.where("kind = 'failure'"))
    return out.select("seq", "will_retry", F.col("retry_count").cast("bigint").alias("retry_count"), F.col("priority").cast("bigint").alias("priority"))


@query("fr_depth", f"""WITH RECURSIVE {CTE_LINKS}, b AS (SELECT page_id AS node, 0 AS depth FROM pages WHERE page_id IN (5, 8)
  UNION SELECT l.dst, b.depth + 1 FROM b JOIN page_links l ON l.src = b.node WHERE b.depth < 6) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY node""")
def fr_depth(t):
    seeds = t.pages.where("page_id IN (5, 8)").select(F.col("page_id").alias("node"))
    found = frontier.depths(t.page_links, seeds, 6)
    return found.select("node", F.col("depth").cast("bigint").alias("depth"))


@query("rd_record", f"WITH {CTE_EVENTS}, {REDIRECTS} SELECT start, count(*) AS hops FROM red WHERE start <> final GROUP BY start")
def rd_record(t):
    return frontier.recorded_redirects(redirects(t)).groupBy("start").agg(F.count(F.lit(1)).alias("hops"))


@query("rd_loop", f"""WITH {CTE_EVENTS}, {REDIRECTS}, r AS (SELECT * FROM red WHERE start <> final) SELECT DISTINCT final AS url FROM r
  WHERE start IN (SELECT start FROM r GROUP BY start HAVING count(*) >= 6)""")
def rd_loop(t):
    return frontier.redirect_loops(redirects(t), 6)


MAPS = """SELECT page_id, concat('https://example.com/s/', CAST(page_id % 120 AS STRING)) AS loc, CAST(page_id % 8 AS INT) AS part,
  CASE page_id % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '' WHEN 2 THEN '0.8' ELSE '0.25' END AS priority FROM {pages}"""


def sitemap_files(t):
    """Sitemap files, an index and an index that it lists, written from the given pages.

    An index is a file for every thousand pages.  It names a map, a nested index,
    files that are not there and more than ten files in all; the nested one names
    its parent and two maps.
    """
    from siteatlas.sources import sitemaps, tables

    folder = tables.scratch(t.spark, "sitemaps")
    rows = t.spark.sql(MAPS, pages=t.pages)
    urls = rows.select("part", "page_id", F.struct(F.concat(F.lit(" "), F.col("loc"), F.lit(" ")).alias("loc"), F.lit("2024-01-02").alias("lastmod"), "priority").alias("u"))
    for part in range(8):
        urls.where(F.col("part") == part).repartitionByRange(F.desc("page_id")).sortWithinPartitions(F.desc("page_id")).select("u.*").write.format("xml").option(
            "rootTag", "urlset").option("rowTag", "url").save(f"{folder}/map{part}")
    for name, rule in (("index", "CASE page_id % 1000 WHEN 0 THEN 'map1' WHEN 1 THEN 'nested' WHEN 2 THEN 'map2' WHEN 10 THEN 'map5' ELSE concat('none', CAST(page_id AS STRING)) END"),
                       ("nested", "CASE page_id % 1000 WHEN 0 THEN 'map4' WHEN 1 THEN 'index' ELSE 'map1' END")):
        listed = t.pages.selectExpr("page_id", "floor(page_id / 1000) AS block", f"concat('https://example.com/', {rule}) AS loc")
        listed.repartition("block").sortWithinPartitions("block", "page_id").select("block", "loc").write.format("xml").option(
            "rootTag", "sitemapindex").option("rowTag", "sitemap").partitionBy("block").save(f"{folder}/{name}")
    return sitemaps, folder


PRIORITY = "CASE page_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.25::DOUBLE END"


@query("src_sitemap", f"SELECT 'https://example.com/s/' || (page_id % 120) AS url, {PRIORITY} AS priority, epoch_us(TIMESTAMP '2024-01-02') AS lastmod_us FROM pages")
def src_sitemap(t):
    sitemaps, folder = sitemap_files(t)
    found = sitemaps.read_sitemap(t.spark, f"{folder}/map*")
    return found.select("url", "priority", F.unix_micros("lastmod").alias("lastmod_us"))


@query("src_sitemap_index", f"SELECT 'https://example.com/s/' || (page_id % 120) AS url, {PRIORITY} AS priority FROM pages WHERE page_id % 8 IN (1, 2, 4)")
def src_sitemap_index(t):
    """Entries of the listed maps: two of the index, one more of the nested index; the eleventh is not followed."""
    sitemaps, folder = sitemap_files(t)
    return sitemaps.expanded(t.spark, folder).select("url", "priority")


@query("sm_discover", """WITH f AS (SELECT 'https://example.com/s/' || (page_id % 120) AS url, min(page_id % 8) AS part, max(page_id) AS last FROM pages GROUP BY 1)
  SELECT url FROM f ORDER BY part, last DESC LIMIT 25""")
def sm_discover(t):
    """The maps list their newest pages first, so the order of discovery is not the order of the URLs."""
    sitemaps, folder = sitemap_files(t)
    entries = sitemaps.read_sitemap(t.spark, f"{folder}/map*")
    return sitemaps.discovered(entries, U.Scope("https://example.com/"), 25).select("url")


@query("pipe_hooks", f"""WITH {CTE_EVENTS} SELECT seq, CASE WHEN retry_count < 3 AND priority < 5 AND priority <> 2 THEN priority + 100 ELSE priority END AS priority,
  CASE WHEN retry_count >= 3 THEN 'aborted' WHEN priority = 2 THEN 'skipped' WHEN user_id % 10 = 9 THEN 'cancelled' END AS ended FROM ev""")
def pipe_hooks(t):
    """Before navigation: give up after three tries, skip a priority, lower others, cancel a user's crawl."""
    hooks = [frontier.Hook("tries", "retry_count >= 3", ends="aborted"), frontier.Hook("skip", "priority = 2", ends="skipped"),
             frontier.Hook("later", "priority < 5", changes={"priority": "priority + 100"}),
             frontier.Hook("stop", "user_id % 10 = 9", ends="cancelled")]
    done = frontier.run_hooks(t.crawl_events, "beforeNavigate", hooks)
    return done.select("seq", "priority", F.col("_ended").alias("ended"))
