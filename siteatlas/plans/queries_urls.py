"""URL expressions over the page URLs and the derived URL shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.plans.catalog import CTE_URLS, Tables, query

HTTP = r"(?is)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
IS_HTTP = f"regexp_matches(url, '{HTTP}')"
RAW = "lower(regexp_extract(url, '(?is)^https?://([^/?#]*)', 1))"
AUTH = f"CASE WHEN url ILIKE 'http:%' THEN regexp_replace({RAW}, ':80$', '') ELSE regexp_replace({RAW}, ':443$', '') END"
SCHEME = "lower(regexp_extract(url, '(?i)^([a-z][a-z0-9+.-]*):', 1))"
PATH = f"coalesce(nullif(regexp_extract(url, '{HTTP}', 3), ''), '/')"
SEARCH = f"nullif(regexp_extract(url, '{HTTP}', 4), '?')"
ORIGIN = f"({SCHEME} || '://' || {AUTH})"


def names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# One pass over the pieces; the other checks read from it.
PARTS = f"""{CTE_URLS}, parts AS (SELECT page_id, k, url, {IS_HTTP} AS http, {SCHEME} AS scheme, {ORIGIN} AS origin,
  regexp_replace({AUTH}, ':[0-9]+$', '') AS hostname, {PATH} AS path, coalesce({SEARCH}, '') AS search FROM urls),
params AS (SELECT *, list_transform(list_filter(string_split(substr(search, 2), '&'), lambda p: p <> ''), lambda p:
  {{'k': url_decode(regexp_extract(p, '^([^=]*)', 1)), 'v': url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))}}) AS ps
  FROM parts)"""
STRIPPED = U.TRACKING_PARAMS + U.SESSION_PARAMS


def over_urls(t: Tables, **columns):
    return t.urls.select("page_id", F.col("k").cast("bigint").alias("k"),
                         *[c.alias(name) for name, c in columns.items()])


@query("url_parts", f"""WITH {PARTS} SELECT page_id, k, CASE WHEN http THEN origin END AS origin,
  CASE WHEN http THEN hostname END AS hostname, CASE WHEN http THEN path END AS path,
  CASE WHEN http THEN search END AS search FROM parts""")
def url_parts(t):
    ok = U.is_http(F.col("url"))
    return over_urls(t, origin=F.when(ok, U.origin(F.col("url"))), hostname=F.when(ok, U.hostname(F.col("url"))),
                     path=F.when(ok, U.path(F.col("url"))), search=F.when(ok, U.search(F.col("url"))))


@query("url_normalize", f"""WITH {PARTS}, kept AS (SELECT page_id, k, url, http, origin, path,
  list_sort(list_transform(list_filter(ps, lambda p: lower(p.k) NOT IN ({names(STRIPPED)})),
    lambda p: [p.k || ',' || p.v, replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')])) AS l
  FROM params) SELECT page_id, k, CASE WHEN NOT http THEN url WHEN len(l) > 0
    THEN origin || path || '?' || array_to_string(list_transform(l, lambda x: x[2]), '&')
    WHEN path = '/' THEN origin || path ELSE origin || regexp_replace(path, '/$', '') END AS normalized FROM kept""")
def url_normalize(t):
    return over_urls(t, normalized=U.normalize(F.col("url")))


@query("url_strip_params", f"""WITH {PARTS} SELECT page_id, k, CAST(len(ps) AS BIGINT) AS params,
  array_to_string(list_transform(list_filter(ps, lambda p: lower(p.k) NOT IN ({names(STRIPPED)})),
    lambda p: p.k || '=' || p.v), '&') AS kept FROM params""")
def url_strip_params(t):
    kept = F.array_join(F.transform(U.kept_params(F.col("url")), lambda p: F.concat(p.k, F.lit("="), p.v)), "&")
    return over_urls(t, params=F.size(U.query_params(F.col("url"))).cast("bigint"), kept=kept)


@query("url_hash", f"""WITH {CTE_URLS} SELECT page_id, k, substr(sha256(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(url), '^https?://', ''), '^www\\.', ''), '#.*$', ''), '/$', '')), 1, 16) AS url_hash FROM urls""")
def url_hash(t):
    return over_urls(t, url_hash=U.url_hash(F.col("url")))


@query("url_pattern", f"""WITH {PARTS} SELECT page_id, k, CASE WHEN http THEN origin || regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(path, '/[0-9]+', '/:id', 'g'),
  '(?i)/[a-f0-9]{{8}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{12}}', '/:uuid', 'g'),
  '(?i)/[a-f0-9]{{32,}}', '/:hash', 'g'), ':[0-9]+', '/:num', 'g')
  || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(list_sort(list_transform(ps, lambda p: p.k || '=' ||
    CASE WHEN regexp_full_match(p.v, '[0-9]+') THEN ':num' WHEN length(p.v) > 50 THEN ':token' ELSE p.v END)), '&') END
  END AS pattern FROM params""")
def url_pattern(t):
    return over_urls(t, pattern=U.pattern(F.col("url")))


SEGS = "list_filter(string_split(path, '/'), lambda s: s <> '')"


@query("url_section", f"""WITH {PARTS} SELECT page_id, k, CASE WHEN http THEN origin || '/' || coalesce({SEGS}[1], '')
  ELSE url END AS section FROM parts""")
def url_section(t):
    return over_urls(t, section=U.section(F.col("url")))


@query("url_is_pagination", f"""WITH {PARTS} SELECT page_id, k, http AND (regexp_matches(lower(path), '/page/[0-9]+|/p/[0-9]+')
  OR regexp_matches(lower(search), '[?&](page|p|pg|offset|start|skip|from|cursor)=[0-9]+')) AS is_pagination FROM parts""")
def url_is_pagination(t):
    return over_urls(t, is_pagination=U.is_pagination(F.col("url")))


@query("url_page_pattern", f"""WITH {CTE_URLS} SELECT page_id, k, regexp_replace(url, '[0-9]+', ':n', 'g') AS page_pattern FROM urls""")
def url_page_pattern(t):
    return over_urls(t, page_pattern=U.page_pattern(F.col("url")))


@query("url_is_redirector", f"""WITH {PARTS} SELECT page_id, k, http AND (regexp_matches(lower(search),
  '[?&](redirect|return|next|continue|goto|url|target|dest|destination)=') OR contains(lower(path), '/redirect')
  OR contains(lower(path), '/goto') OR contains(lower(path), '/bounce')) AS is_redirector FROM parts""")
def url_is_redirector(t):
    return over_urls(t, is_redirector=U.is_redirector(F.col("url")))


@query("url_depth", f"""WITH {PARTS} SELECT page_id, k, CAST(CASE WHEN http THEN len({SEGS}) ELSE -1 END AS BIGINT) AS depth FROM parts""")
def url_depth(t):
    return over_urls(t, depth=U.depth(F.col("url")).cast("bigint"))


@query("url_rel_depth", f"""WITH {PARTS} SELECT page_id, k, CAST(CASE WHEN http THEN len({SEGS}) - 1 ELSE -1 END AS BIGINT) AS rel_depth FROM parts""")
def url_rel_depth(t):
    return over_urls(t, rel_depth=U.relative_depth(F.col("url"), "https://example.com/docs").cast("bigint"))


DEEP = U.Scope("https://example.com/docs", "depth_only", 3)
SAME = U.Scope("https://example.com/docs", "same_domain", include=("/docs/", "login"), exclude=("/abf[0-9]/", "page/7"))
FULL = U.Scope("https://example.com/docs", "full")
PLAIN = "CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END"


@query("url_in_scope", f"""WITH {PARTS}, why AS (SELECT page_id, k,
  CASE WHEN NOT http AND scheme = '' THEN 'invalid URL format' WHEN NOT http THEN 'not HTTP/HTTPS protocol' END AS bad,
  url, origin, {PLAIN} AS path, len({SEGS}) - 1 AS extra FROM parts)
SELECT page_id, k, coalesce(bad, CASE WHEN origin <> 'https://example.com' THEN 'different domain'
    WHEN NOT (starts_with(path, '/docs') AND (path = '/docs' OR (extra > 0 AND extra <= 3))) THEN 'not deeper than base path' END, 'allowed') AS depth_only,
  coalesce(bad, CASE WHEN regexp_matches(url, 'abf[0-9]') OR contains(url, 'page/7') THEN 'matches exclude pattern'
    WHEN NOT (regexp_matches(url, 'docs') OR contains(url, 'login')) THEN 'does not match include pattern'
    WHEN origin <> 'https://example.com' THEN 'different domain (origin)' END, 'allowed') AS same_domain,
  coalesce(bad, 'allowed') AS everything FROM why""")
def url_in_scope(t):
    def said(scope):
        return F.coalesce(U.in_scope(F.col("url"), scope)["reason"], F.lit("allowed"))
    return over_urls(t, depth_only=said(DEEP), same_domain=said(SAME), everything=said(FULL))


@query("url_match_patterns", f"""WITH {CTE_URLS} SELECT page_id, k, regexp_matches(url, 'docs') AS as_regex, contains(url, 'docs/a1') AS as_text,
  contains(url, '/[/') AS broken, contains(url, '/(?P<x_1>a)/') AS foreign_syntax FROM urls""")
def url_match_patterns(t):
    return over_urls(t, as_regex=U.matches_any(F.col("url"), ("/docs/",)), as_text=U.matches_any(F.col("url"), ("docs/a1",)),
                     broken=U.matches_any(F.col("url"), ("/[/",)),
                     foreign_syntax=U.matches_any(F.col("url"), ("/(?P<x_1>a)/",)))


@query("url_hierarchy", f"""WITH {PARTS} SELECT page_id, k, CASE WHEN http THEN repeat('  ', greatest(len({SEGS}) - 1, 0)) ELSE '' END
  || CASE WHEN http AND origin = 'https://example.com' THEN '✓ ' ELSE '✗ ' END
  || CASE WHEN http THEN path || search ELSE url END AS line FROM parts""")
def url_hierarchy(t):
    return over_urls(t, line=U.hierarchy_line(F.col("url"), U.Scope("https://example.com/docs")))


HREFS = "['/a/b', 'c.html?x=1', '//cdn.example.org/z', '?q=2', '#top', 'https://other.example.com/', 'mailto:a@b.c', '']"
BASE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
BPATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"
BQUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
RESOLVED = f"""res AS (SELECT page_id, href, url, CASE WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || href
  WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN {BASE} || href
  WHEN href LIKE '?%' THEN {BASE} || {BPATH} || href WHEN href LIKE '#%' OR href = '' THEN {BASE} || {BPATH} || {BQUERY} || href
  ELSE {BASE} || regexp_replace({BPATH}, '[^/]*$', '') || href END AS resolved
  FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages))"""


def hrefs(t):
    listed = F.expr("array('/a/b', 'c.html?x=1', '//cdn.example.org/z', '?q=2', '#top', "
                    "'https://other.example.com/', 'mailto:a@b.c', '')")
    return t.pages.select("page_id", "url", F.explode(listed).alias("href"))


@query("url_resolve", f"WITH {RESOLVED} SELECT page_id, href, resolved FROM res")
def url_resolve(t):
    return hrefs(t).select("page_id", "href", U.resolve(F.col("href"), F.col("url")).alias("resolved"))


@query("url_same_origin", f"WITH {RESOLVED} SELECT page_id, href, regexp_extract(resolved, '^(https?://[^/?#]+)', 1) = {BASE} AS internal FROM res")
def url_same_origin(t):
    return hrefs(t).select("page_id", "href", U.same_origin(F.col("href"), F.col("url")).alias("internal"))


@query("url_is_download", f"""WITH {CTE_URLS} SELECT page_id, k, regexp_matches(url, '(?i)\\.({"|".join(U.DOWNLOAD_EXTENSIONS)})$') AS is_download FROM urls""")
def url_is_download(t):
    return over_urls(t, is_download=U.is_download(F.col("url")))


@query("url_is_cross_domain", f"""WITH {PARTS} SELECT page_id, k, http AND hostname <> 'example.com' AS cross_domain FROM parts""")
def url_is_cross_domain(t):
    return over_urls(t, cross_domain=U.is_cross_domain(F.lit("https://example.com/start"), F.col("url")))


@query("url_is_login", f"""WITH {CTE_URLS} SELECT page_id, k, regexp_matches(lower(url), '/login|/signin|/sign-in|/sign_in|/auth|/sso|/session/new|/sessions/new') AS is_login FROM urls""")
def url_is_login(t):
    return over_urls(t, is_login=U.is_login(F.col("url")))


@query("url_resource_class", f"""WITH {CTE_URLS} SELECT page_id, k, CASE WHEN regexp_matches(lower(url), '\\.(woff|woff2|ttf|eot|otf)') THEN 'font'
  WHEN regexp_matches(lower(url), '\\.(mp4|webm|ogg|avi|mov|mp3|wav|flac|aac|gif)') THEN 'media'
  WHEN len(list_filter([{names(U.TRACKER_HOSTS)}], lambda d: contains(url, d))) > 0 THEN 'tracker' ELSE 'page' END AS class FROM urls""")
def url_resource_class(t):
    return over_urls(t, **{"class": U.resource_class(F.col("url"))})


@query("url_sanitize", f"""WITH {PARTS} SELECT page_id, k, CASE WHEN http AND NOT regexp_matches(lower(url), 'javascript:|data:|vbscript:')
  THEN origin || path || regexp_extract(url, '{HTTP}', 4) || regexp_extract(url, '{HTTP}', 5) END AS clean FROM parts""")
def url_sanitize(t):
    return over_urls(t, clean=U.sanitize(F.col("url")))
