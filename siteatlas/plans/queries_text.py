"""Text, hash, JSON and number expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.functions import text as X
from siteatlas.operators import quality
from siteatlas.plans.catalog import CTE_EVENTS, Tables, query

STRIP = ("regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), "
         "'&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#x27;', ''''), '^\\s+|\\s+$', '', 'g')")


@query("txt_strip_html", f"SELECT page_id, {STRIP} AS stripped FROM pages")
def txt_strip_html(t: Tables):
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("stripped"))


@query("txt_sanitize", f"SELECT page_id, regexp_replace(substr({STRIP}, 1, 300), '^\\s+|\\s+$', '', 'g') AS clean FROM pages")
def txt_sanitize(t):
    return t.pages.select("page_id", X.sanitize(F.col("html"), 300).alias("clean"))


NESTED = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("inner", T.StructType([T.StructField("note", T.StringType())])),
    T.StructField("tags", T.ArrayType(T.StringType()))])


@query("txt_sanitize_nested", f"""WITH s AS (SELECT page_id, {STRIP} AS x FROM pages)
  SELECT page_id, regexp_replace(substr(x, 1, 1000), '\\s+$', '') AS name, CAST(length(regexp_replace(substr(x, 1, 1000), '\\s+$', '')) AS BIGINT) AS n,
  'b' AS note, regexp_replace(substr(x, 1, 1000), '\\s+$', '') AS tag FROM s""")
def txt_sanitize_nested(t):
    made = F.struct(F.col("html").alias("name"), F.lit(1).alias("n"),
                    F.struct(F.lit(" <i>b</i> ").alias("note")).alias("inner"), F.array(F.col("html")).alias("tags"))
    clean = X.sanitize_nested(made, NESTED)
    return (t.pages.select("page_id", clean.alias("v"))
            .select("page_id", F.col("v.name").alias("name"), F.length("v.name").cast("bigint").alias("n"),
                    F.col("v.inner.note").alias("note"), F.col("v.tags")[0].alias("tag")))


@query("txt_valid_name", "SELECT c_custkey, regexp_full_match(replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE '_' END), '[a-zA-Z0-9\\s\\-_.,()]{1,200}') AS valid FROM customer")
def txt_valid_name(t):
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    return t.read("customer").select("c_custkey", X.is_valid_name(name).alias("valid"))


SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')"


@query("txt_slug", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def txt_slug(t):
    return t.read("documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


FLAT = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("txt_truncate", f"SELECT doc_id, CASE WHEN length({FLAT}) > 80 THEN substr({FLAT}, 1, 77) || '...' ELSE {FLAT} END AS short FROM documents")
def txt_truncate(t):
    return t.read("documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query("hash_content", "SELECT page_id, substr(sha256(html), 1, 16) AS content_hash FROM pages")
def hash_content(t):
    return t.pages.select("page_id", X.content_hash(F.col("html")).alias("content_hash"))


@query("hash_visual", """SELECT doc_id, substr(sha256(CASE WHEN doc_id % 4 = 0 THEN text
  ELSE substr(to_base64(encode(text)), 1, 10000) END), 1, 16) AS visual_hash FROM documents""")
def hash_visual(t):
    image = F.when(F.col("doc_id") % 4 == 0, F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.encode("text", "utf-8"))
    return t.read("documents").select("doc_id", X.visual_hash(image, X.content_hash(F.col("text"))).alias("visual_hash"))


@query("hash_structure", """WITH f AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  len(regexp_extract_all(html, '<a ')) AS links FROM pages)
  SELECT page_id, min(page_id) OVER (PARTITION BY title, links) AS first_alike FROM f""")
def hash_structure(t):
    shape = X.structure_hash(F.size(F.regexp_extract_all(F.col("html"), F.lit("<a "), 0)), F.lit(0),
                             F.regexp_extract(F.col("html"), "<title>(.*?)</title>", 1))
    hashed = t.pages.select("page_id", shape.alias("shape"))
    alike = hashed.groupBy("shape").agg(F.min("page_id").alias("first_alike"))
    return hashed.join(alike, "shape").select("page_id", "first_alike")


@query("num_fp_similarity", """WITH f AS (SELECT doc_id, n_chars, doc_id % 25 AS l, doc_id % 3 AS f FROM documents)
  SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END) + (1::DOUBLE - least(abs(l - 4) + abs(f - 1), 20) / 20::DOUBLE) * 0.3::DOUBLE
  + (1::DOUBLE - least(abs(n_chars - 1000) / greatest(n_chars, 1000)::DOUBLE, 1::DOUBLE)) * 0.3::DOUBLE AS score FROM f""")
def num_fp_similarity(t):
    a = F.struct(F.when(F.col("doc_id") % 2 == 0, "same").otherwise("other").alias("title"),
                 (F.col("doc_id") % 25).alias("links"), (F.col("doc_id") % 3).alias("forms"),
                 F.col("n_chars").alias("length"))
    b = F.struct(F.lit("same").alias("title"), F.lit(4).alias("links"), F.lit(1).alias("forms"), F.lit(1000).alias("length"))
    return t.read("documents").select("doc_id", X.fingerprint_similarity(a, b).alias("score"))


@query("num_sitemap_priority", """SELECT event_id, CASE WHEN p IS NULL OR p = 0 THEN 10::BIGINT ELSE CAST(floor((1 - p) * 20 + 0.5) AS BIGINT) END AS priority
  FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 11) / 10.0::DOUBLE END AS p FROM events)""")
def num_sitemap_priority(t):
    p = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 11) / F.lit(10.0))
    return t.events.select("event_id", X.sitemap_priority(p).cast("bigint").alias("priority"))


@query("num_backoff", "SELECT event_id, 2000::DOUBLE * pow(2, event_id % 6) AS delay_ms FROM events")
def num_backoff(t):
    return t.events.select("event_id", X.backoff_ms(F.col("event_id") % 6).alias("delay_ms"))


@query("err_key", f"WITH {CTE_EVENTS} SELECT seq, error_type || ': ' || substr(error_message, 1, 100) AS error_key FROM ev WHERE kind = 'failure'")
def err_key(t):
    return t.crawl_events.where("kind = 'failure'").select(
        "seq", X.error_key(F.col("error_type"), F.col("error_message")).alias("error_key"))


@query("err_retryable", f"""WITH {CTE_EVENTS} SELECT seq, retry_count < 2 AND NOT regexp_matches(lower(error_message),
  'net::err_aborted|invalid url|protocol error') AS retryable FROM ev WHERE kind = 'failure'""")
def err_retryable(t):
    return t.crawl_events.where("kind = 'failure'").select(
        "seq", X.is_retryable(F.col("retry_count"), F.col("error_message")).alias("retryable"))


# Model answers as they come back: JSON inside prose, cut JSON, no JSON.
ANSWER = """CASE doc_id % 4 WHEN 0 THEN concat('Sure: {"page_purpose":"p', CAST(doc_id AS STRING),
  '","elements":[{"selector":"a","description":"', lang, '"}],"steps":["s1","s2"]} done') WHEN 1 THEN 'no answer'
  WHEN 2 THEN concat('{"page_purpose":"q', CAST(doc_id AS STRING), '"}') ELSE '{"page_purpose": ' END AS answer"""
CTE_ANSWERS = f"ans AS (SELECT doc_id, {ANSWER} FROM documents)"


def answers(t):
    return t.read("documents").selectExpr("doc_id", ANSWER)


OUTER = "nullif(regexp_extract(answer, '(?s)(\\{.*\\})', 1), '')"


@query("json_outermost", f"""WITH {CTE_ANSWERS} SELECT doc_id, {OUTER} AS json FROM ans""")
def json_outermost(t):
    return answers(t).select("doc_id", X.outermost_json(F.col("answer")).alias("json"))


@query("json_validate", f"""WITH {CTE_ANSWERS}, j AS (SELECT doc_id, {OUTER} AS j FROM ans)
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN j ->> '$.page_purpose' WHEN doc_id % 4 = 2 THEN j ->> '$.page_purpose' END AS page_purpose,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS steps, CAST(0 AS BIGINT) AS target_users,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 2 THEN 'elements,steps' ELSE 'page_purpose,elements,steps' END AS missing FROM j""")
def json_validate(t):
    checked = quality.validated_answers(answers(t), "answer")
    return checked.select("doc_id", "page_purpose", F.size(F.coalesce("steps", F.array())).cast("bigint").alias("steps"),
                          F.size("target_users").cast("bigint").alias("target_users"),
                          F.array_join("missing", ",").alias("missing"))


# Project configurations derived from customers.
CONFIGS = """SELECT c_custkey AS project_id, c_name AS name,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'ftp://x.example.com' WHEN c_custkey % 7 = 2 THEN 'nope' ELSE 'https://x.example.com' END AS base_url,
  CAST(c_custkey % 23 AS INT) AS max_depth, CAST(c_custkey % 1100 AS INT) AS max_pages,
  CASE c_custkey % 5 WHEN 0 THEN 'email_password' WHEN 1 THEN 'magic' WHEN 2 THEN 'session' ELSE 'none' END AS auth_type,
  CASE WHEN c_custkey % 10 = 0 THEN 'a@b.co' WHEN c_custkey % 10 = 5 THEN 'bad' ELSE '' END AS email,
  CASE WHEN c_custkey % 15 = 0 THEN 'pw' ELSE '' END AS password, CAST(c_custkey % 2 AS INT) AS cookie_count,
  CASE WHEN c_custkey % 4 = 0 THEN 'docx' ELSE 'markdown' END AS format FROM {customer}"""


@query("cfg_validate", f"""WITH c AS ({CONFIGS.replace('{customer}', 'customer')}), v AS (SELECT project_id, unnest([
  CASE WHEN base_url = '' THEN 'base_url is required' WHEN base_url LIKE 'ftp%' THEN 'Invalid URL scheme: ftp:. Must be http or https.'
    WHEN base_url = 'nope' THEN 'Invalid URL: nope' END,
  CASE WHEN max_depth < 1 OR max_depth > 20 THEN 'max_depth must be an integer between 1 and 20' END,
  CASE WHEN max_pages < 1 OR max_pages > 1000 THEN 'max_pages must be an integer between 1 and 1000' END,
  CASE WHEN auth_type = 'magic' THEN 'Invalid auth type: magic. Must be one of: none, email_password, session, oauth' END,
  CASE WHEN auth_type = 'email_password' AND email = '' THEN 'email is required for email_password auth' END,
  CASE WHEN auth_type = 'email_password' AND password = '' THEN 'password is required for email_password auth' END,
  CASE WHEN auth_type = 'email_password' AND email = 'bad' THEN 'Invalid email format: bad' END,
  CASE WHEN auth_type = 'session' AND cookie_count = 0 THEN 'session_cookies is required for session auth' END,
  CASE WHEN format = 'docx' THEN 'Invalid output format: docx. Must be one of: markdown, html, pdf, word' END]) AS violation FROM c)
  SELECT project_id, violation FROM v WHERE violation IS NOT NULL""")
def cfg_validate(t):
    flat = t.spark.sql(CONFIGS, customer=t.read("customer"))
    config = F.struct(
        "name", F.col("base_url").alias("baseUrl"),
        F.struct(F.col("max_depth").alias("maxDepth"), F.col("max_pages").alias("maxPages")).alias("scope"),
        F.struct(F.col("auth_type").alias("type"), "email", "password",
                 F.when(F.col("cookie_count") > 0, F.create_map(F.lit("sid"), F.lit("x"))).alias("sessionCookies")).alias("auth"),
        F.struct(F.array("format").alias("formats")).alias("output"))
    return quality.config_violations(flat.select("project_id", F.to_json(config).alias("config")))
