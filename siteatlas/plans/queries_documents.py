"""Analysis, prompt tables, documents, checkpoints and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import urls as U
from siteatlas.operators import classify, graph, structure
from siteatlas.plans import documents
from siteatlas.plans.catalog import CTE_RICH, CTE_SNAPS, Tables, query
from siteatlas.plans.queries_archive import HASHED, captured
from siteatlas.plans.queries_classify import H1, STRUCTURAL
from siteatlas.plans.queries_extract import CLEAN, TITLE
from siteatlas.plans.queries_graph import GRAPH, HUB_FLOWS, both
from siteatlas.plans.queries_stats import project_documents, projects, sessions
from siteatlas.sources import tables

@query("an_run", f"""WITH {CTE_RICH}, x AS ({STRUCTURAL}) SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '{{}}' ELSE page_purpose END AS purpose FROM x""")
def an_run(t: Tables):
    rows = t.rich_pages.select("page_id", U.url_hash(F.concat("url", F.lit("?id="), F.col("page_id").cast("string"))).alias("page_url_hash"),
                               F.lit("").alias("page_title"), "html", F.when(F.col("page_id") % 4 == 1, F.lit("{}")).alias("analysis_json"))
    out = documents.analyze_pending(rows.select("page_id", "page_url_hash", "analysis_json"), rows.select("page_url_hash", "page_title", "html"))
    return out.select("page_id", F.coalesce(F.get_json_object("analysis", "$.page_purpose"), "analysis").alias("purpose"))


@query("dc_prompt_page", f"""WITH {CTE_RICH} SELECT page_id, 'PAGE: "' || {TITLE} || '" at ' || url || chr(10) || 'HEADINGS ON PAGE: ' || {H1} || chr(10) || 'BUTTONS: ' ||
  coalesce(nullif(array_to_string(list_concat(CASE WHEN page_id % 3 = 0 THEN ['Go & find'] ELSE [] END, CASE WHEN page_id % 4 = 0 THEN ['Save all ' || (page_id % 10), 'No'] ELSE [] END), ', '), ''), 'None')
  || chr(10) || 'FORMS: ' || (CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT)) || chr(10) || 'LINKS: ' || len(regexp_extract_all({CLEAN}, '<a [^>]*href=')) AS context FROM rich""")
def dc_prompt_page(t):
    return documents.page_prompts(structure.doc_page(t.rich_pages))


def project_pages(t):
    """Pages of four projects, every third analysed."""
    bare = F.col("bare")
    read = structure.staged(t.pages)
    return read.select(
        (F.col("page_id") % 4).alias("project_id"), F.col("page_id").alias("seq"), "url", H.title(bare).alias("title"),
        U.url_hash(F.col("url")).alias("url_hash"),
        F.when(F.col("page_id") % 3 == 0, classify.structural_analysis(F.col("html"), F.lit(""))).alias("analysis"))


def project_flows(t):
    found, links = both(t)
    flows = graph.hub_workflows(found, links).withColumn("strategy", F.lit(3))
    return flows.withColumn("project_id", F.col("seq") % 4)


def project_heads(t):
    ids = t.pages.select((F.col("page_id") % 4).alias("project_id")).distinct()
    return ids.select("project_id", F.concat(F.lit("App "), F.col("project_id").cast("string")).alias("name"),
                      F.concat(F.lit("https://app"), F.col("project_id").cast("string"), F.lit(".example.com")).alias("url"))


@query("dc_prompt_site", f"""WITH {GRAPH}, {HUB_FLOWS}, e AS (SELECT n.page_id % 4 AS project_id, n.page_id AS seq, e.src, e.dst FROM edges e JOIN p n ON 'page:' || n.url = e.src),
  er AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq, src, dst) AS position FROM e)
  SELECT page_id % 4 AS project_id, 'page' AS kind, page_id AS position, '[' || page_id || '] "' || title || '" (' || url || ') — ' || title || ' page' AS line FROM p
  UNION ALL SELECT project_id, 'edge', position, src || ' → ' || dst FROM er WHERE position <= 40
  UNION ALL SELECT page_id % 4, 'workflow', page_id, name || ': ' || string_agg(action, ' → ' ORDER BY step) FROM wf3 JOIN p ON 'hub:page:' || p.url = workflow GROUP BY page_id, name""")
def dc_prompt_site(t):
    found, links = both(t)
    pages = found.where("type = 'page'").select((F.col("seq") % 4).alias("project_id"), "seq", "title", "url", F.concat("title", F.lit(" page")).alias("purpose"))
    owned = links.join(found.where("type = 'page'").select(F.col("id").alias("src"), "seq"), "src").withColumn("project_id", F.col("seq") % 4)
    return documents.site_prompts(pages, owned.select("project_id", "seq", "src", "dst"), project_flows(t))


ANSWER = """CASE doc_id % 5 WHEN 0 THEN concat('Here: {"purpose":"p', CAST(doc_id AS STRING), '","keyElements":["k1","k2"],"userActions":["go"]} bye') WHEN 1 THEN 'nothing'
  WHEN 2 THEN concat('{"purpose":"","what_user_sees":"s', CAST(doc_id AS STRING), '","key_elements":["z"]}') WHEN 3 THEN '{"purpose": ' END AS answer"""


@query("dc_llm_merge", """SELECT doc_id AS page_index, CASE doc_id % 5 WHEN 0 THEN 'p' || doc_id ELSE 'T' || doc_id || ' page' END AS purpose, CASE doc_id % 5 WHEN 2 THEN 's' || doc_id ELSE '' END AS sees,
  CASE doc_id % 5 WHEN 0 THEN 'k1,k2' WHEN 2 THEN 'z' WHEN 4 THEN '"b' || lang || '" button' ELSE '' END AS elements, CASE doc_id % 5 WHEN 0 THEN 'go' ELSE '' END AS actions FROM documents""")
def dc_llm_merge(t):
    docs = t.read("documents")
    pages = docs.select(F.col("doc_id").alias("page_index"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
                        F.array(F.concat(F.lit("b"), F.col("lang"))).alias("buttons"))
    answers = docs.selectExpr("doc_id AS page_index", ANSWER).where("answer IS NOT NULL")
    out = documents.merge_page_answers(pages, answers)
    return out.select("page_index", "purpose", "sees", F.array_join("elements", ",").alias("elements"), F.array_join("actions", ",").alias("actions"))


# One architecture answer per project; pages are numbered within it.
SITES = """SELECT c_custkey AS project_id, c_name AS name, concat('https://c', CAST(c_custkey AS STRING), '.example.com') AS url,
  CASE c_custkey % 3 WHEN 0 THEN '{"appName":"N","appDescription":"D","sections":[{"name":"One & all","description":"d1","pages":[1,0,9]},{"name":"Two","description":"d2","pages":[7]}],"gettingStartedPages":[1,0]}'
    WHEN 1 THEN 'no json' END AS answer FROM customer"""
PAGES = """SELECT o_custkey AS project_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_index, concat('Order ', CAST(o_orderkey AS STRING)) AS title,
  concat('https://o.example.com/', CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'Sign in here' ELSE 'List' END AS purpose FROM orders"""


def sites(t):
    name = t.read("customer").selectExpr("c_custkey AS project_id", "c_name AS name", "concat('https://c', CAST(c_custkey AS STRING), '.example.com') AS url",
        """CASE c_custkey % 3 WHEN 0 THEN '{"appName":"N","appDescription":"D","sections":[{"name":"One & all","description":"d1","pages":[1,0,9]},{"name":"Two","description":"d2","pages":[7]}],"gettingStartedPages":[1,0]}' WHEN 1 THEN 'no json' END AS answer""")
    pages = t.read("orders").selectExpr(
        "o_custkey AS project_id", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_index",
        "concat('Order ', CAST(o_orderkey AS STRING)) AS title", "concat('https://o.example.com/', CAST(o_orderkey AS STRING)) AS url",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Sign in here' ELSE 'List' END AS purpose", "array('a1', 'a2', 'a3', 'a4') AS actions")
    return name, pages


SECTIONS = f"""s AS ({SITES}), pg AS ({PAGES}), sec AS (SELECT project_id, unnest([0, 1]) AS section, unnest(['One & all', 'Two']) AS section_name, unnest(['d1', 'd2']) AS section_description FROM s WHERE project_id % 3 = 0
  UNION ALL SELECT project_id, 0, 'Features', CASE project_id % 3 WHEN 1 THEN 'All features' ELSE 'Application features' END FROM s WHERE project_id % 3 <> 0),
mem AS (SELECT project_id, unnest([0, 0, 0, 1]) AS section, unnest([0, 1, 2, 0]) AS position, unnest([1, 0, 9, 7]) AS page_index FROM s WHERE project_id % 3 = 0
  UNION ALL SELECT project_id, 0, page_index, page_index FROM pg WHERE project_id % 3 <> 0),
placed AS (SELECT mem.*, title, url, purpose FROM mem JOIN pg USING (project_id, page_index))"""


@query("dc_sections", f"""WITH {SECTIONS} SELECT sec.project_id, CAST(section AS BIGINT) AS section, section_name, section_description,
  (SELECT count(*) FROM placed p WHERE p.project_id = sec.project_id AND p.section = sec.section) AS pages FROM sec""")
def dc_sections(t):
    name, pages = sites(t)
    _, sections, members = documents.site_sections(name, pages)
    counts = documents.section_pages(members, pages).groupBy("project_id", "section").agg(F.count(F.lit(1)).alias("pages"))
    return sections.join(counts, ["project_id", "section"], "left").select(
        "project_id", F.col("section").cast("bigint").alias("section"), "section_name", "section_description", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("dc_assemble", f"""WITH {SECTIONS}, h AS (SELECT project_id, CASE project_id % 3 WHEN 0 THEN 'N' ELSE name END AS name, url, CASE project_id % 3 WHEN 0 THEN 'D' WHEN 1 THEN '' ELSE name || ' web application' END AS description,
    CASE project_id % 3 WHEN 0 THEN [1, 0] ELSE [0] END AS started FROM s),
  g AS (SELECT project_id, unnest(range(len(started))) AS position, unnest(started) AS page_index FROM h), st AS (SELECT g.*, purpose FROM g JOIN pg USING (project_id, page_index)),
  hs AS (SELECT *, project_id IN (SELECT project_id FROM st) AS has FROM h),
  parts AS (SELECT project_id, 10 AS part, 0 AS seq, ['# ' || name || ' — User Documentation', '', '> ' || description, '', '---', '', '## Table of Contents', '', '- [Getting Started](#getting-started)'] AS l, 0 AS base FROM h
    UNION ALL SELECT project_id, 20, section, ['- [' || section_name || '](#' || CASE section_name WHEN 'One & all' THEN 'one-all' ELSE lower(section_name) END || ')'], 0 FROM sec
    UNION ALL SELECT project_id, 30, 0, list_concat(['', '---', '', '## Getting Started', ''], CASE WHEN has THEN ['To start using ' || name || ':', '', '1. Open [' || url || '](' || url || ') in your browser'] ELSE ['Navigate to [' || url || '](' || url || ') to get started.', ''] END), 0 FROM hs
    UNION ALL SELECT project_id, 40, position, ['2. Sign in here', '3. a1', '3. a2', '3. a3'], 0 FROM st WHERE purpose LIKE 'Sign%'
    UNION ALL SELECT project_id, 50, 0, CASE WHEN has THEN ['', '---', ''] ELSE ['---', ''] END, 0 FROM hs
    UNION ALL SELECT project_id, 60, section * 2, ['## ' || section_name, ''], 0 FROM sec
    UNION ALL SELECT project_id, 60, section * 2, ['### ' || title, '', purpose, '', '**URL:** `' || url || '`', ''], position * 6 + 2 FROM placed
    UNION ALL SELECT project_id, 60, section * 2, ['*' || section_description || '*'], 2 FROM sec WHERE (project_id, section) NOT IN (SELECT (project_id, section) FROM placed)
    UNION ALL SELECT project_id, 60, section * 2 + 1, ['', '---', ''], 0 FROM sec
    UNION ALL SELECT project_id, 70, 0, ['*Documentation generated by atlas for [' || name || '](' || url || ')*'], 0 FROM h)
  SELECT project_id, CAST(part AS BIGINT) AS part, CAST(seq AS BIGINT) AS seq, CAST(base + unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS line FROM parts""")
def dc_assemble(t):
    name, pages = sites(t)
    heads, sections, members = documents.site_sections(name, pages)
    return lines_of(documents.assembled_lines(heads, sections, members, pages, "atlas"))


def lines_of(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("part", "seq", "line_no")})


def markdown(t):
    totals = t.pages.select((F.col("page_id") % 4).alias("project_id")).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.lit(7).alias("edges"), F.lit(5).alias("elements"))
    return documents.markdown_lines(project_heads(t), project_pages(t), project_flows(t), totals, "January 2, 2024", "atlas")


SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')"
NO_ANALYSIS = "*No detailed analysis available. Run AI analysis for enhanced documentation.*"
MARKDOWN = f"""{GRAPH}, {HUB_FLOWS}, pp AS (SELECT page_id, page_id % 4 AS project_id, url, {TITLE} AS title, {H1} AS h1 FROM pages),
fl AS (SELECT page_id % 4 AS project_id, page_id, name, description, step, page, action FROM wf3 JOIN p ON 'hub:page:' || p.url = workflow),
fh AS (SELECT project_id, page_id, name, description, row_number() OVER (PARTITION BY project_id ORDER BY page_id) AS number FROM (SELECT DISTINCT project_id, page_id, name, description FROM fl)),
hd AS (SELECT project_id, count(*) AS n, count(*) FILTER (page_id % 3 = 0) AS a, (SELECT count(*) FROM fh WHERE fh.project_id = pp.project_id) AS f,
  'App ' || project_id AS name, 'https://app' || project_id || '.example.com' AS url FROM pp GROUP BY project_id),
parts AS (SELECT project_id, 10 AS part, 0 AS seq, ['# ' || name || ' - User Documentation', '', '> Auto-generated documentation for [' || url || '](' || url || ')', '> Generated on January 2, 2024', '', '---', '',
    '## Table of Contents', '', '- [Overview](#overview)', '- [Pages](#pages)', '- [Workflows](#workflows)', '- [Statistics](#statistics)', ''] AS l, 0 AS base FROM hd
  UNION ALL SELECT project_id, 20, page_id, ['  - [' || title || '](#' || {SLUG} || ')'], 0 FROM pp
  UNION ALL SELECT project_id, 30, 0, ['', '---', '', '## Overview', '', 'This documentation covers **' || n || ' pages** of the ' || name || ' application.', 'The application contains **5 interactive elements** across all pages.',
    '**' || f || ' user workflows** have been identified.', '', '---', ''], 0 FROM hd
  UNION ALL SELECT project_id, 40, 0, ['## Pages', ''], 0 FROM hd
  UNION ALL SELECT project_id, 50, page_id, list_concat(['### ' || title, '', '**URL:** `' || url || '`', ''], CASE WHEN page_id % 3 = 0 THEN ['**Purpose:** ' || title || ' - ' || h1, '', '**Target Users:** General users', '',
    '#### How to Use', '', '1. Navigate to ' || title, '1. Review "' || h1 || '" section', '', '---', ''] ELSE ['{NO_ANALYSIS}', '', '---', ''] END), 0 FROM pp
  UNION ALL SELECT project_id, 60, 0, ['## Workflows', ''], 0 FROM hd
  UNION ALL SELECT project_id, 70, number, ['### ' || number || '. ' || name, '', description, ''], 0 FROM fh
  UNION ALL SELECT fl.project_id, 70, number, [step || '. **' || action || '** on *' || page || '*'], step + 9 FROM fl JOIN fh USING (project_id, page_id)
  UNION ALL SELECT project_id, 70, number, ['', '---', ''], 1073741824 FROM fh
  UNION ALL SELECT project_id, 80, 0, ['## Statistics', '', '| Metric | Value |', '|--------|-------|', '| Total Pages | ' || n || ' |', '| Total UI Elements | 5 |', '| Graph Nodes | ' || n || ' |', '| Graph Edges | 7 |',
    '| Detected Workflows | ' || f || ' |', '| Pages with AI Analysis | ' || a || ' |', '', '---', '', '*Generated by atlas on January 2, 2024*'], 0 FROM hd),
md AS (SELECT project_id, CAST(part AS BIGINT) AS part, CAST(seq AS BIGINT) AS seq, CAST(base + unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS line FROM parts)"""


@query("dc_markdown", f"WITH {MARKDOWN} SELECT * FROM md")
def dc_markdown(t):
    return lines_of(markdown(t))


@query("sink_docs", f"WITH {MARKDOWN} SELECT project_id, 'markdown' AS format, CAST(sum(octet_length(encode(line)) + 1) - 1 AS BIGINT) AS size, count(*) AS lines FROM md GROUP BY project_id")
def sink_docs(t):
    lines = markdown(t).withColumn("format", F.lit("markdown"))
    return tables.store_documents(lines, tables.scratch(t.spark, "documents"))


# ---- checkpoints and exports ------------------------------------------------------

def state(t, part: int):
    """Frontier state after ``part`` rounds over the given pages."""
    visited = t.pages.where(F.col("page_id") % 3 < part).select(U.normalize(F.col("url")).alias("url"), "page_id")
    queue = t.pages.where(F.col("page_id") % 3 >= part).select("page_id", "url")
    return {"visited": visited, "queue": queue}


def stored(t):
    folder = tables.scratch(t.spark, "state")
    tables.save_checkpoint(state(t, 1), folder, "007", "2024-01-01 00:00:00")
    tables.save_checkpoint(state(t, 2), folder, "7", "2024-01-01 01:00:00")
    return folder


@query("ckpt_save", "SELECT '007' AS id, count(*) FILTER (page_id % 3 < 1) AS visited, count(*) FILTER (page_id % 3 >= 1) AS queued FROM pages UNION ALL SELECT '7', count(*) FILTER (page_id % 3 < 2), count(*) FILTER (page_id % 3 >= 2) FROM pages")
def ckpt_save(t):
    sizes = tables.checkpoint_sizes(t.spark, stored(t), ("visited", "queue"))
    return sizes.select("id", "visited", F.col("queue").alias("queued"))


@query("ckpt_load", "SELECT 'latest' AS asked, page_id FROM pages WHERE page_id % 3 < 2 UNION ALL SELECT '007', page_id FROM pages WHERE page_id % 3 < 1")
def ckpt_load(t):
    folder = stored(t)
    return tables.load_checkpoint(t.spark, folder, "visited").select(F.lit("latest").alias("asked"), "page_id").unionByName(
        tables.load_checkpoint(t.spark, folder, "visited", "007").select(F.lit("007").alias("asked"), "page_id"))


@query("ckpt_list", "SELECT CAST(event_id % 4 AS VARCHAR) AS id, epoch_us(max(ts)) AS taken_us FROM events GROUP BY 1")
def ckpt_list(t):
    """A checkpoint for each of four crawls, taken at the crawl's last event."""
    folder = tables.scratch(t.spark, "state")
    rows = t.events.select((F.col("event_id") % 4).cast("string").alias("checkpoint_id"), "event_id", "ts")
    taken = rows.groupBy(F.col("checkpoint_id").alias("id")).agg(F.max("ts").alias("taken_at"))
    tables.save_checkpoints({"visited": rows.select("checkpoint_id", "event_id")}, folder, taken)
    return tables.list_checkpoints(t.spark, folder).select("id", F.unix_micros("taken_at").alias("taken_us"))


@query("ckpt_delete", "SELECT page_id FROM pages WHERE page_id % 3 < 1")
def ckpt_delete(t):
    folder = stored(t)
    tables.delete_checkpoint(t.spark, folder, "7", ("visited", "queue"))
    return tables.load_checkpoint(t.spark, folder, "visited").select("page_id")


@query("export_project", f"WITH {CTE_SNAPS}, {HASHED} SELECT snapshot_id, content_hash FROM h WHERE project_id = 'src5'")
def export_project(t):
    folder = tables.scratch(t.spark, "export")
    tables.export_project({"snapshots": captured(t)}, "src5", folder)
    return t.spark.read.parquet(f"{folder}/snapshots").select("snapshot_id", "content_hash")


@query("restore_project", f"WITH {CTE_SNAPS}, {HASHED} SELECT snapshot_id, project_id FROM h WHERE project_id IN ('src5', 'src6')")
def restore_project(t):
    folder, target = tables.scratch(t.spark, "export"), tables.scratch(t.spark, "restored")
    rows = captured(t)
    rows.where("project_id = 'src6'").write.parquet(f"{target}/snapshots")
    tables.export_project({"snapshots": rows}, "src5", folder)
    tables.restore_project(t.spark, folder, ["snapshots"], target)
    return t.spark.read.parquet(f"{target}/snapshots").select("snapshot_id", "project_id")


@query("export_user", "SELECT o_orderkey AS session_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def export_user(t):
    folder = tables.scratch(t.spark, "user")
    tables.export_user(projects(t), {"sessions": sessions(t), "documents": project_documents(t)}, 3, folder)
    return t.spark.read.parquet(f"{folder}/sessions").select("session_id")
