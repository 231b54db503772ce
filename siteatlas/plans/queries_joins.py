"""Joins the inventory names on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import structure
from siteatlas.plans import documents
from siteatlas.plans.catalog import Tables, query
from siteatlas.plans.queries_stats import projects, sessions
from siteatlas.sources import robots


@query("join_owner", """SELECT o_orderstatus AS state, count(*) AS sessions FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1""")
def join_owner(t: Tables):
    mine = projects(t).where("owner = 7").select("project_id")
    return sessions(t).join(mine, "project_id", "left_semi").groupBy(
        F.when(F.col("status") == "COMPLETED", "F").when(F.col("status") == "RUNNING", "O").otherwise("P").alias("state")).agg(
        F.count(F.lit(1)).alias("sessions"))


@query("join_inner_ref", "SELECT o_orderkey AS session_id, c_name AS project FROM orders JOIN customer ON c_custkey = o_custkey")
def join_inner_ref(t):
    return sessions(t).join(projects(t), "project_id").select("session_id", F.col("name").alias("project"))


ROBOTS = r"""concat('User-agent: *', chr(10), 'Disallow: /en/1', chr(10), 'Allow: /en/12', chr(10), '# Disallow: /', chr(10), 'Disallow: /de', chr(10),
  'Crawl-delay: ', CAST(length(host) % 4 AS STRING), '.5', chr(10), 'Sitemap: https://', host, '/map.xml', chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10),
  'User-agent: *', chr(10), 'User-agent: atlas', chr(10), 'Allow: /de/2', chr(10), 'Disallow: /de/2', chr(10), 'Disallow:', chr(10), 'Allow: /fr', chr(10), 'Disallow: /fr') AS body"""


def bodies(t):
    hosts = t.pages.select(U.hostname(F.col("url")).alias("host")).distinct()
    return hosts.selectExpr("host", ROBOTS)


HOST = "regexp_extract(lower(url), '^https?://([^/?#:]*)', 1)"
PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"


@query("join_robots", f"""WITH r(path, allow, line) AS (VALUES ('/en/1', false, 1), ('/en/12', true, 2), ('/de', false, 3), ('/de/2', true, 4), ('/de/2', false, 5), ('/fr', true, 6), ('/fr', false, 7)),
  m AS (SELECT page_id, arg_max(allow, (length(r.path), line)) AS allow FROM pages LEFT JOIN r ON starts_with({PATH}, r.path) GROUP BY page_id) SELECT page_id, coalesce(allow, true) AS allowed FROM m""")
def join_robots(t):
    rules = robots.robots_rules(bodies(t), "atlas")
    return robots.mark_allowed(t.pages.select("page_id", "url"), rules, "allowed").select("page_id", "allowed")


@query("src_robots", f"SELECT DISTINCT {HOST} AS host, 7::BIGINT AS rules, 'https://' || {HOST} || '/map.xml' AS sitemaps FROM pages")
def src_robots(t):
    rules = robots.robots_rules(bodies(t), "atlas")
    return rules.select("host", F.size("rules").cast("bigint").alias("rules"), F.array_join("sitemaps", ",").alias("sitemaps"))


@query("robots_rules", f"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages) SELECT host, unnest(['/en/1', '/en/12', '/de', '/fr', '/fr', '/de/2', '/de/2']) AS path,
  unnest([false, true, false, true, false, true, false]) AS allow FROM h""")
def robots_rules(t):
    rules = robots.robots_rules(bodies(t), "ATLAS")
    return rules.select("host", F.inline("rules")).select("host", "path", "allow")


@query("fr_crawl_delay", f"SELECT DISTINCT {HOST} AS host, greatest(1000::DOUBLE, (length({HOST}) % 4 + 0.5) * 1000::DOUBLE) AS delay_ms FROM pages")
def fr_crawl_delay(t):
    return robots.crawl_delay(robots.robots_rules(bodies(t), "atlas"), 1000)


@query("join_labels", "SELECT page_id, 'q' || page_id AS id, 'Find it' AS label FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, '', NULL FROM pages, range(5) WHERE page_id % 5 = 0 UNION ALL SELECT page_id, '', NULL FROM pages, range(2) WHERE page_id % 3 = 0 UNION ALL SELECT page_id, '', NULL FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, '', NULL FROM pages WHERE page_id % 4 = 0")
def join_labels(t):
    return structure.field_labels(t.rich_pages)


@query("join_sample_values", """SELECT page_id, unnest(['q', 'sort', 'tok']) AS name, unnest(['test', 'name', NULL]) AS sample FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, unnest(['email', 'pw', 'note', 'keep']), unnest(['test@example.com', NULL, NULL, NULL]) FROM pages WHERE page_id % 5 = 0""")
def join_sample_values(t):
    inputs = structure.form_inputs(t.rich_pages).where(F.col("name").isNotNull())
    return inputs.select("page_id", "name", structure.sample_value(F.col("name")).alias("sample"))


@query("join_section_pages", """SELECT lang AS project_id, source AS section, doc_id AS page_index, n_chars FROM documents WHERE doc_id % 3 <> 0""")
def join_section_pages(t):
    """Sections name page indexes; every third has no analysis and drops out."""
    docs = t.read("documents").select(F.col("lang").alias("project_id"), F.col("source").alias("section"),
                                      F.col("doc_id").alias("page_index"), "n_chars")
    analyses = docs.where("page_index % 3 <> 0").select("project_id", "page_index", "n_chars")
    return documents.section_pages(docs.select("project_id", "section", "page_index"), analyses).select(
        "project_id", "section", "page_index", "n_chars")
