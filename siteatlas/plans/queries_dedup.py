"""URL and page deduplication over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import dedup
from siteatlas.plans.catalog import CTE_EVENTS, CTE_LINKS, Tables, query
from siteatlas.plans.queries_extract import LINKS, TITLE
from siteatlas.plans.queries_urls import PARTS, STRIPPED, names

NORMALIZED = f"""{PARTS}, kept AS (SELECT page_id, k, url, http, origin, path,
  list_sort(list_transform(list_filter(ps, lambda p: lower(p.k) NOT IN ({names(STRIPPED)})),
    lambda p: [p.k || ',' || p.v, replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')])) AS l FROM params),
norm AS (SELECT page_id * 16 + k AS seq, page_id, url, CASE WHEN NOT http THEN url WHEN len(l) > 0
    THEN origin || path || '?' || array_to_string(list_transform(l, lambda x: x[2]), '&')
    WHEN path = '/' THEN origin || path ELSE origin || regexp_replace(path, '/$', '') END AS normalized FROM kept)"""


def requests(t: Tables):
    return t.urls.select((F.col("page_id") * 16 + F.col("k")).alias("seq"), "page_id", "url")


@query("dd_url", f"WITH {NORMALIZED} SELECT normalized, min(seq) AS seq, arg_min(url, seq) AS url FROM norm GROUP BY normalized")
def dd_url(t):
    return dedup.first_per_url(requests(t), ["seq"]).select("normalized", "seq", "url")


@query("dd_url_admission", f"WITH {NORMALIZED} SELECT seq, row_number() OVER (PARTITION BY normalized ORDER BY seq) = 1 AS added FROM norm")
def dd_url_admission(t):
    return dedup.admission(requests(t), ["seq"]).select("seq", "added")


@query("set_seen", f"WITH {NORMALIZED} SELECT seq FROM norm WHERE normalized IN (SELECT normalized FROM norm WHERE page_id % 2 = 0)")
def set_seen(t):
    rows = requests(t)
    return dedup.seen(rows, rows.where("page_id % 2 = 0")).select("seq")


@query("join_visited_anti", f"WITH {NORMALIZED} SELECT seq, url FROM norm WHERE normalized NOT IN (SELECT normalized FROM norm WHERE page_id % 2 = 0)")
def join_visited_anti(t):
    rows = requests(t)
    return dedup.unseen(rows, rows.where("page_id % 2 = 0")).select("seq", "url")


@query("set_domains", f"""WITH {CTE_EVENTS} SELECT domain FROM ev WHERE kind = 'success' UNION SELECT domain FROM ev WHERE kind = 'failure'""")
def set_domains(t):
    events = t.crawl_events
    return events.where("kind = 'success'").select("domain").union(events.where("kind = 'failure'").select("domain")).distinct()


@query("set_union_sources", f"""WITH {NORMALIZED}, {CTE_LINKS}, c AS (SELECT normalized AS n, seq, 0 AS source FROM norm
  UNION ALL SELECT n2.normalized || '/linked', src * 8 + position, 1 FROM page_links JOIN norm n2 ON n2.page_id = dst AND n2.seq % 16 = 1
  UNION ALL SELECT n2.normalized, src * 8 + position, 1 FROM page_links JOIN norm n2 ON n2.page_id = dst AND n2.seq % 16 = 0), w AS (SELECT n, source, seq, row_number() OVER (PARTITION BY n ORDER BY source, seq) AS r FROM c)
  SELECT n AS normalized, CAST(source AS BIGINT) AS source, seq FROM w WHERE r = 1""")
def set_union_sources(t):
    rows = requests(t).select("seq", "url", F.lit(0).alias("source"))
    # Links lead to pages that are requested anyhow, and to one below the page's documentation that no request names.
    target = t.urls.where("k < 2").select(F.col("page_id").alias("dst"), F.when(F.col("k") == 0, F.col("url")).otherwise(
        F.concat(F.regexp_replace("url", "/$", ""), F.lit("/linked"))).alias("url"))
    linked = t.page_links.join(target, "dst").select(
        (F.col("src") * 8 + F.col("position")).alias("seq"), "url", F.lit(1).alias("source"))
    first = dedup.first_per_url(rows.unionByName(linked), ["source", "seq"])
    return first.select("normalized", F.col("source").cast("bigint").alias("source"), "seq")


# Fingerprints of the rule-made pages, as the check sees them.
PRINTS = f"""{LINKS}, n AS (SELECT page_id, count(*) AS links FROM out_links GROUP BY page_id),
fp AS (SELECT rich.page_id AS seq, url, {TITLE} AS title, coalesce(links, 0) AS links,
  CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) AS forms, length(html) AS length, row_number() OVER (ORDER BY page_id) AS i FROM rich LEFT JOIN n USING (page_id))"""


def score(a: str, b: str) -> str:
    return f"""((CASE WHEN {a}.title = {b}.title THEN 0.4::DOUBLE ELSE 0::DOUBLE END) + (1::DOUBLE - least(abs({a}.links - {b}.links) + abs({a}.forms - {b}.forms), 20) / 20::DOUBLE) * 0.3::DOUBLE
  + (1::DOUBLE - least(abs({a}.length - {b}.length) / greatest({a}.length, {b}.length)::DOUBLE, 1::DOUBLE)) * 0.3::DOUBLE)"""


SAME = "(k.title = f.title AND k.links = f.links AND k.forms = f.forms)"
GREEDY = f"""RECURSIVE {PRINTS}, r AS (SELECT 0::BIGINT AS i, []::STRUCT(seq BIGINT, title VARCHAR, links BIGINT, forms INT, length BIGINT)[] AS kept
  UNION ALL SELECT f.i, CASE WHEN len(list_filter(kept, lambda k: {SAME} OR {score('f', 'k')} >= 0.85)) > 0 THEN kept
    ELSE list_append(kept, {{'seq': f.seq, 'title': f.title, 'links': f.links, 'forms': f.forms, 'length': f.length}}) END FROM r JOIN fp f ON f.i = r.i + 1),
  chosen AS (SELECT unnest(kept, recursive := true) FROM r WHERE i = (SELECT max(i) FROM r))"""


@query("dd_exact_content", f"""WITH {PRINTS} SELECT seq FROM fp QUALIFY row_number() OVER (PARTITION BY title, links, forms ORDER BY seq) > 1""")
def dd_exact_content(t):
    return dedup.exact_duplicates(dedup.fingerprints(t.rich_pages)).select("seq")


@query("dd_near_content", f"WITH {GREEDY} SELECT fp.seq, k.seq IS NOT NULL AS kept FROM fp LEFT JOIN chosen k ON k.seq = fp.seq")
def dd_near_content(t):
    return dedup.near_duplicates(dedup.fingerprints(t.rich_pages)).select("seq", "kept")


@query("join_similar", f"""WITH {GREEDY}, m AS (SELECT f.seq AS seq, k.seq AS ks, {SAME} AS same, {score('f', 'k')} AS score FROM fp f JOIN chosen k ON k.seq < f.seq AND ({SAME} OR {score('f', 'k')} >= 0.85)
  WHERE f.seq NOT IN (SELECT seq FROM chosen))
  SELECT seq, CASE WHEN bool_or(same) THEN 'structure' ELSE 'similar' END AS reason, CASE WHEN NOT bool_or(same) THEN min(ks) END AS similar_to,
  CASE WHEN NOT bool_or(same) THEN CAST(floor(arg_min(score, ks) * 100 + 0.5) AS BIGINT) END AS percent FROM m GROUP BY seq""")
def join_similar(t):
    found = dedup.near_duplicates(dedup.fingerprints(t.rich_pages)).where(~F.col("kept"))
    return found.select("seq", "reason", "similar_to", F.floor(F.col("score") * 100 + 0.5).alias("percent"))


SITE = "regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), ':[0-9]+$', '')"


@query("win_diminishing", f"""WITH {PRINTS}, s AS (SELECT *, regexp_extract({SITE}, '[^.]+\\.(?:com|net|org)$') AS site FROM fp), p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS position FROM s),
  m AS (SELECT n.seq, n.site, n.position, round(sum({score('a', 'b')}) / 6, 9) AS mean_similarity FROM p n JOIN p a ON a.site = n.site AND a.position BETWEEN n.position - 3 AND n.position
  JOIN p b ON b.site = n.site AND b.position > a.position AND b.position <= n.position WHERE n.position >= 4 GROUP BY ALL)
  SELECT seq, position, mean_similarity, mean_similarity > 0.8 AS diminishing FROM m""")
def win_diminishing(t):
    prints = dedup.fingerprints(t.rich_pages)
    domain = F.concat(F.lit("https://"), F.regexp_extract(U.hostname(F.col("url")), r"[^.]+\.(?:com|net|org)$", 0))
    found = dedup.diminishing_returns(prints.withColumn("url", domain), recent=4, chunk_rows=16)
    return found.select("seq", "position", F.round("mean_similarity", 9).alias("mean_similarity"), "diminishing")


# Canonical and alternate targets taken from the link stand-in.
CANON = f"""{CTE_LINKS}, c AS (SELECT p.page_id AS seq, p.url, q.url AS canonical, regexp_replace(regexp_replace(p.url, '#.*$', ''), '([?&])(ref=x|utm_source=feed)', '', 'g') AS o,
  regexp_replace(regexp_replace(q.url, '#.*$', ''), '([?&])(ref=x|utm_source=feed)', '', 'g') AS g FROM pages p LEFT JOIN page_links l ON l.src = p.page_id AND l.position = 0 LEFT JOIN pages q ON q.page_id = l.dst),
  x AS (SELECT seq, url, canonical, regexp_replace(o, '/$', '') AS own, regexp_replace(g, '/$', '') AS target FROM c)"""


def with_canonical(t):
    first = t.page_links.where("position = 0").join(
        t.pages.select(F.col("page_id").alias("dst"), F.col("url").alias("canonical")), "dst").select(
        F.col("src").alias("seq"), "canonical")
    return t.pages.select(F.col("page_id").alias("seq"), "url").join(first, "seq", "left")


CANON_DUPES = f"""WITH {CANON}, v AS (SELECT own, min(seq) AS original_seq FROM x GROUP BY own)
  SELECT seq, url, canonical, original_seq FROM x JOIN v ON v.own = x.target WHERE x.own <> x.target AND original_seq < seq"""


@query("join_canonical", CANON_DUPES)
def join_canonical(t):
    return dedup.canonical_duplicates(with_canonical(t))


@query("dd_canonical", f"""WITH {CANON}, v AS (SELECT own, min(seq) AS original_seq FROM x GROUP BY own),
  d AS (SELECT seq FROM x JOIN v ON v.own = x.target WHERE x.own <> x.target AND original_seq < seq),
  alt AS (SELECT DISTINCT n.own FROM page_links l JOIN x n ON n.seq = l.dst WHERE l.position = 1)
  SELECT seq FROM x WHERE seq NOT IN (SELECT seq FROM d) AND own NOT IN (SELECT own FROM alt)""")
def dd_canonical(t):
    rows = with_canonical(t)
    unique = rows.join(dedup.canonical_duplicates(rows).select("seq"), "seq", "left_anti")
    return dedup.without_alternates(unique, alternates(t)).select("seq")


def alternates(t):
    return t.page_links.where("position = 1").join(t.pages.select(F.col("page_id").alias("dst"), "url"), "dst").select("url")


@query("join_hreflang_anti", f"""WITH {CANON}, alt AS (SELECT DISTINCT n.own FROM page_links l JOIN x n ON n.seq = l.dst WHERE l.position = 1)
  SELECT seq, url FROM x WHERE own NOT IN (SELECT own FROM alt)""")
def join_hreflang_anti(t):
    return dedup.without_alternates(t.pages.select(F.col("page_id").alias("seq"), "url"), alternates(t)).select("seq", "url")
