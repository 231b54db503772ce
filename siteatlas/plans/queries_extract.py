"""Page-structure extraction over the given pages.

The given pages hold no forms, buttons or head links, so those jobs read
``rich_pages``: the same pages with such parts added by rule.  Their checks
state the expected rows from the rule, not from a second parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.functions import html as H
from siteatlas.functions import urls as U
from siteatlas.operators import dom, structure
from siteatlas.operators.structure import staged
from siteatlas.operators.archive import latest_per_url
from siteatlas.plans.catalog import CTE_RICH, Tables, query

BASE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
BPATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"

BQUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"


def un(text: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def tidy(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def plain(fragment: str) -> str:
    return tidy(un(f"regexp_replace({fragment}, '<[^>]*>', '', 'g')"))


CLEAN = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"
TITLE = tidy(f"regexp_replace({un('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')}, '\\s+', ' ', 'g')")


def rows(t, frame, items, **columns):
    """(page_id, position, fields...) of an array column."""
    out = structure.exploded(frame, items).withColumn("position", F.col("position").cast("bigint"))
    if not columns:
        return out.select("page_id", "position", "item.*")
    return out.select("page_id", "position", *[F.expr(e).alias(n) for n, e in columns.items()])


@query("src_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def src_pages(t: Tables):
    return t.pages.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("ext_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def ext_title(t):
    return staged(t.pages).select("page_id", H.title(F.col("bare")).alias("title"))


ANCHORS = f"""blocks AS (SELECT page_id, url, regexp_extract_all({CLEAN}, '(?is)<a [^>]*>.*?</a>') AS l FROM rich),
a AS (SELECT page_id, url, unnest(range(len(l))) AS i, unnest(l) AS b FROM blocks),
links AS (SELECT page_id, url, i, regexp_extract(b, 'href="([^"]*)"', 1) AS raw, {plain('b')} AS text FROM a),
kept AS (SELECT page_id, i, text, regexp_replace(regexp_replace(CASE WHEN raw LIKE 'http%' THEN raw WHEN raw LIKE '#%'
  THEN {BASE} || {BPATH} || {BQUERY} || raw ELSE {BASE} || raw END, '#.*$', ''), '/$', '') AS href,
  regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS here FROM links)"""
LINKS = f"""{CTE_RICH}, {ANCHORS}, firsts AS (SELECT page_id, i, href, text, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS n
  FROM kept WHERE href <> here), out_links AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position, href,
  substr(text, 1, 200) AS text FROM firsts WHERE n = 1)"""


@query("ext_links", f"WITH {LINKS} SELECT page_id, position, href, text FROM out_links")
def ext_links(t):
    return structure.links(t.rich_pages).withColumn("position", F.col("position").cast("bigint"))


@query("ext_nav_links", f"""WITH {CTE_RICH}, {ANCHORS}, n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position,
  coalesce(nullif(text, ''), 'Link') AS label, 'a[href="' || {un('raw')} || '"]' AS selector, {un('raw')} AS href, '' AS target FROM links
  WHERE raw <> '#' AND raw <> '') SELECT * FROM n WHERE position < 50""")
def ext_nav_links(t):
    return rows(t, staged(t.rich_pages), H.nav_links(F.col("bare")))


FORMS = f"""f AS (SELECT page_id, url, 0 AS form, {BASE} || '/search/' || (page_id % 11) AS action, 'GET' AS method,
  unnest([{{'name': 'q', 'type': 'search', 'required': true}}, {{'name': 'sort', 'type': 'select', 'required': false}},
  {{'name': 'tok', 'type': 'hidden', 'required': false}}]) AS x FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, url, 'POST',
  unnest([{{'name': 'email', 'type': 'email', 'required': false}}, {{'name': 'pw', 'type': 'password', 'required': true}},
  {{'name': 'note', 'type': 'textarea', 'required': false}}, {{'name': 'keep', 'type': 'checkbox', 'required': false}},
  {{'name': NULL, 'type': 'radio', 'required': false}}, {{'name': NULL, 'type': 'submit', 'required': false}}]) FROM pages WHERE page_id % 5 = 0)"""


@query("ext_forms", f"WITH {FORMS} SELECT page_id, CAST(form AS BIGINT) AS form, action, method, x.name AS name, x.type AS type, x.required AS required FROM f")
def ext_forms(t):
    return structure.form_inputs(t.rich_pages).withColumn("form", F.col("form").cast("bigint"))


@query("ext_form_fields", """WITH f AS (SELECT page_id, 0 AS form, unnest([
  {'kind': 'input', 'label': 'Find it', 'value': '', 'required': true, 'selector': '#q' || page_id},
  {'kind': 'select', 'label': 'sort', 'value': 'new', 'required': false, 'selector': '[name="sort"]'},
  {'kind': 'input', 'label': 'tok', 'value': 'x', 'required': false, 'selector': '[name="tok"]'},
  {'kind': 'button', 'label': 'Go & find', 'value': '', 'required': false, 'selector': 'form:nth-of-type(1) button:nth-of-type(1)'}]) AS x
  FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, n, unnest([
  {'kind': 'input', 'label': 'Email', 'value': '', 'required': false, 'selector': '[name="email"]'},
  {'kind': 'input', 'label': 'pw', 'value': '', 'required': true, 'selector': '[name="pw"]'},
  {'kind': 'textarea', 'label': 'note', 'value': 'n' || (page_id % 4), 'required': false, 'selector': '[name="note"]'},
  {'kind': 'checkbox', 'label': 'keep', 'value': 'on', 'required': false, 'selector': '[name="keep"]'},
  {'kind': 'radio', 'label': 'Unnamed Field', 'value': 'on', 'required': false, 'selector': 'form:nth-of-type(' || (n + 1) || ') input:nth-of-type(5)'},
  {'kind': 'input', 'label': 'Unnamed Field', 'value': 'Sign in', 'required': false, 'selector': 'form:nth-of-type(' || (n + 1) || ') input:nth-of-type(6)'},
  {'kind': 'button', 'label': 'Sign in', 'value': '', 'required': false, 'selector': 'form:nth-of-type(' || (n + 1) || ') button:nth-of-type(1)'}])
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM pages WHERE page_id % 5 = 0))
  SELECT page_id, CAST(form AS BIGINT) AS form, x.kind AS kind, x.label AS label, x.value AS value, x.required AS required, x.selector AS selector FROM f""")
def ext_form_fields(t):
    return rows(t, staged(t.rich_pages), H.form_fields(F.col("bare")), form="CAST(item.form AS BIGINT)", kind="item.kind", label="item.label",
                value="item.value", required="item.required", selector="item.selector").drop("position")


@query("ext_buttons", """WITH b AS (SELECT page_id, unnest(list_concat(list_concat(
  CASE WHEN page_id % 3 = 0 THEN [{'text': 'Go & find', 'type': 'submit'}] ELSE [] END,
  CASE WHEN page_id % 5 = 0 THEN [{'text': 'Sign in', 'type': 'submit'}] ELSE [] END),
  CASE WHEN page_id % 4 = 0 THEN [{'text': 'Save all ' || (page_id % 10), 'type': NULL}, {'text': '', 'type': NULL}, {'text': 'Reset', 'type': 'button'}] ELSE [] END)) AS x FROM pages)
  SELECT page_id, x.text AS text, x.type AS type FROM b""")
def ext_buttons(t):
    return rows(t, staged(t.rich_pages), H.buttons(F.col("bare"))).drop("position")


@query("ext_loose_buttons", """WITH b AS (SELECT page_id, CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) AS n FROM pages WHERE page_id % 4 = 0),
  u AS (SELECT page_id, unnest([{'label': 'Save all ' || (page_id % 10), 'selector': 'button:nth-of-type(' || (n + 1) || ')'},
  {'label': 'Menu', 'selector': 'div[aria-label="Menu"]'}, {'label': 'Reset', 'selector': 'input:nth-of-type(' || (n + 3) || ')'}]) AS x FROM b)
  SELECT page_id, x.label AS label, x.selector AS selector FROM u""")
def ext_loose_buttons(t):
    return rows(t, staged(t.rich_pages), H.loose_buttons(F.col("bare"))).drop("position")


@query("ext_meta", """SELECT page_id, unnest(['description', 'og:type']) AS name, unnest(['About & more ' || (page_id % 12), 'article']) AS content FROM pages""")
def ext_meta(t):
    return staged(t.rich_pages).select("page_id", F.explode(H.meta(F.col("bare"))).alias("name", "content"))


@query("ext_headings", f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all({CLEAN}, '(?is)<h[1-4]>.*?</h[1-4]>')) AS b FROM pages)
  SELECT page_id, CAST(substr(b, 3, 1) AS BIGINT) AS level, substr({plain('b')}, 1, 200) AS text FROM h""")
def ext_headings(t):
    return rows(t, staged(t.pages), H.headings(F.col("bare")), level="CAST(item.level AS BIGINT)", text="item.text").drop("position")


BLOCK_END = "(?is)</?(?:" + H.BLOCK_TAGS + ")[\\s/>].*$"


@query("ext_paragraphs", f"""WITH p AS (SELECT page_id, string_split_regex({CLEAN}, '<p(?:\\s[^>]*)?>')[2:] AS l FROM pages),
  x AS (SELECT page_id, list_filter(list_transform(l, lambda b: substr({plain(f"regexp_replace(b, '{BLOCK_END}', '')")}, 1, 200)), lambda s: length(s) > 20)[1:10] AS l FROM p)
  SELECT page_id, unnest(range(len(l))) AS position, unnest(l) AS text FROM x""")
def ext_paragraphs(t):
    return rows(t, staged(t.pages), H.paragraphs(F.col("bare")), text="item")


@query("ext_canonical", f"SELECT page_id, {BASE} || '/c/' || (page_id % 40) AS canonical FROM pages")
def ext_canonical(t):
    return staged(t.rich_pages).select("page_id", H.canonical(F.col("bare"), F.col("url")).alias("canonical"))


@query("ext_hreflang", f"""SELECT page_id, unnest(['de', 'fr']) AS lang, unnest([{BASE} || '/de/' || (page_id % 30), 'https://fr.example.com/x']) AS url FROM pages""")
def ext_hreflang(t):
    return staged(t.rich_pages).select("page_id", F.inline(H.hreflang(F.col("bare"), F.col("url"))))


@query("ext_pagination", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {BASE} || {BPATH} || '?page=' || (page_id % 7 + 1)
    WHEN page_id % 8 = 3 THEN {BASE} || '/p/3' END AS next_url, CASE WHEN page_id % 8 = 3 THEN {BASE} || '/p/1' END AS prev_url,
  CASE WHEN page_id % 8 = 3 THEN CAST(page_id % 5 AS BIGINT) END AS current_page FROM pages""")
def ext_pagination(t):
    found = staged(t.rich_pages).select("page_id", H.pagination(F.col("bare"), F.col("url")).alias("p"))
    return found.select("page_id", "p.next_url", "p.prev_url", F.col("p.current_page").cast("bigint").alias("current_page"))


@query("ext_hash_routes", f"""SELECT page_id, unnest(CASE WHEN page_id % 7 = 0 THEN [{BASE} || {BPATH} || '#/r/' || (page_id % 9), {BASE} || {BPATH} || '#!/s',
  {BASE} || '/route-' || (page_id % 5), {BASE} || '/route/b'] ELSE [] END) AS route FROM pages""")
def ext_hash_routes(t):
    return staged(t.rich_pages).select("page_id", F.explode(H.hash_routes(F.col("html"), F.col("bare"), F.col("url"))).alias("route"))


@query("ext_attr_routes", f"""WITH r AS (SELECT page_id, unnest([{{'url': {BASE} || '/dr/' || (page_id % 6), 'found_by': 'data-attr', 'text': 'D'}},
  {{'url': {BASE} || '/#/r/' || (page_id % 9), 'found_by': 'hash', 'text': 'R'}}, {{'url': {BASE} || '/#!/s', 'found_by': 'hash', 'text': 'S'}}]) AS x
  FROM pages WHERE page_id % 7 = 0) SELECT page_id, x.url AS url, x.found_by AS found_by, x.text AS text FROM r""")
def ext_attr_routes(t):
    return rows(t, staged(t.rich_pages), H.attr_routes(F.col("bare"), F.col("url"))).drop("position")


@query("ext_form_targets", f"SELECT page_id, 0::BIGINT AS form, {BASE} || '/search/' || (page_id % 11) || '?q=test&sort=new' AS target_url FROM pages WHERE page_id % 3 = 0")
def ext_form_targets(t):
    return structure.form_targets(t.rich_pages).withColumn("form", F.col("form").cast("bigint"))


@query("ext_meta_refresh", f"SELECT page_id, CASE WHEN page_id % 6 = 1 THEN {BASE} || '/moved/' || (page_id % 8) END AS target FROM pages")
def ext_meta_refresh(t):
    return staged(t.rich_pages).select("page_id", H.meta_refresh(F.col("bare"), F.col("url")).alias("target"))


@query("ext_resources", """SELECT page_id, CAST(2 + CAST(page_id % 9 = 4 AS INT) + CAST(page_id % 7 = 0 AS INT) AS BIGINT) AS resources FROM pages""")
def ext_resources(t):
    return t.rich_pages.select("page_id", H.resource_count(F.col("html")).cast("bigint").alias("resources"))


@query("ext_aria_tree", f"""WITH x AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<body>.*?</nav>', 0), '<li>') AS li FROM pages)
  SELECT page_id, CAST(len(li) AS BIGINT) AS items, CAST(len(li) AS BIGINT) AS anchors, 1::BIGINT AS navs FROM x""")
def ext_aria_tree(t):
    tree = dom.aria_tree(t.pages)
    return tree.groupBy("page_id").agg(
        F.count_if(F.col("role") == "li").alias("items"), F.count_if((F.col("role") == "a") & (F.col("depth") == 4)).alias("anchors"),
        F.count_if((F.col("role") == "nav") & (F.col("depth") == 1) & (F.col("parent_id") == 0)).alias("navs"))


@query("ext_elements", f"""WITH {CTE_RICH}, e AS (SELECT page_id, regexp_extract_all({CLEAN},
  '<(?:button|input|select|textarea)\\b[^>]*>|<a [^>]*href=[^>]*>|<div role="button"[^>]*>') AS l FROM rich)
  SELECT page_id, unnest(range(len(l))) + 1 AS index, regexp_extract(unnest(l), '^<([a-z]+)', 1) AS tag,
  regexp_extract(unnest(l), ' type="([^"]*)"', 1) AS type, {un("regexp_extract(unnest(l), ' href=\"([^\"]*)\"', 1)")} AS href,
  regexp_extract(unnest(l), ' role="([^"]*)"', 1) AS role FROM e""")
def ext_elements(t):
    found = dom.elements(t.rich_pages)
    return found.select("page_id", F.col("index").cast("bigint").alias("index"), "tag",
                        F.coalesce(F.try_element_at("attributes", F.lit("type")), F.lit("")).alias("type"),
                        F.coalesce(F.try_element_at("attributes", F.lit("href")), F.lit("")).alias("href"), "role")


@query("ext_elements_text", f"""WITH e AS (SELECT page_id, regexp_extract_all({CLEAN}, '(?is)<a href="([^"]*)">', 1) AS h,
  regexp_extract_all({CLEAN}, '(?is)<a href="[^"]*">(.*?)</a>', 1) AS x FROM pages)
  SELECT page_id, CAST(len(h) AS BIGINT) AS element_count, array_to_string(list_transform(range(1, len(h) + 1), lambda i:
    '[' || i || ']<a href="' || {un('h[i]')} || '"' || CASE WHEN x[i] = '' THEN '/>' ELSE '>' || {un('x[i]')} || '</a>' END), chr(10)) AS text FROM e""")
def ext_elements_text(t):
    return dom.elements_text(t.pages).withColumn("element_count", F.col("element_count").cast("bigint"))


@query("ext_metadata", f"""WITH {LINKS}, n AS (SELECT page_id, count(*) AS links FROM out_links GROUP BY page_id)
  SELECT rich.page_id, {TITLE} AS title, CAST(page_id % 9 = 4 AS VARCHAR) AS "isSPA", '1' AS "headingCount",
  CAST(CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) AS VARCHAR) AS "formCount",
  CAST(CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) + 3 * CAST(page_id % 4 = 0 AS INT) AS VARCHAR) AS "buttonCount",
  CAST(coalesce(links, 0) AS VARCHAR) AS "linkCount", 'About & more ' || (page_id % 12) AS description FROM rich LEFT JOIN n USING (page_id)""")
def ext_metadata(t):
    found = structure.metadata(structure.page_structure(t.rich_pages))
    keys = ["title", "isSPA", "headingCount", "formCount", "buttonCount", "linkCount", "description"]
    return found.select("page_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys])


@query("ext_is_spa", "SELECT page_id, page_id % 9 = 4 AS is_spa FROM pages")
def ext_is_spa(t):
    return t.rich_pages.select("page_id", H.is_spa(F.col("html")).alias("is_spa"))


BODY_TEXT = f"lower({plain(f'''regexp_replace({CLEAN}, '(?is)^.*?<body>', '')''')})"


@query("ext_status_guess", f"""WITH {CTE_RICH} SELECT page_id, CASE WHEN {BODY_TEXT} LIKE '%404%' AND {BODY_TEXT} LIKE '%not found%' THEN 404::BIGINT ELSE 200::BIGINT END AS status FROM rich""")
def ext_status_guess(t):
    return t.rich_pages.select("page_id", H.status_guess(F.col("html")).cast("bigint").alias("status"))


@query("ext_clean_html", f"""WITH {CTE_RICH} SELECT page_id, regexp_replace(html,
  '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<footer\\b.*?</footer>|<a class="user-menu".*?</a>', '', 'g') AS cleaned FROM rich""")
def ext_clean_html(t):
    return dom.with_nodes(t.rich_pages).select("page_id", dom.cleaned_html(F.col("html"), F.col("nodes")).alias("cleaned"))


MD_BODY = "regexp_replace(regexp_replace(html, '(?is)^.*?</nav>', ''), '(?is)<footer.*$', '')"


@query("ext_markdown", f"""WITH p AS (SELECT page_id, {plain("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS h1,
  string_split_regex({MD_BODY}, '<p>')[2:] AS l FROM pages),
  x AS (SELECT page_id, list_concat(['# ' || h1 || chr(10)], list_transform(list_filter(list_transform(l, lambda b:
    {plain(f"regexp_replace(regexp_replace(b, '{BLOCK_END}', ''), '(?is)<b>.*$', '')")}), lambda s: length(s) > 10), lambda s: s || chr(10))) AS l FROM p)
  SELECT page_id, {tidy("regexp_replace(array_to_string(l, chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS markdown FROM x""")
def ext_markdown(t):
    return dom.with_nodes(t.pages).select("page_id", dom.markdown(F.col("nodes")).alias("markdown"))


@query("ext_dom_summary", f"""WITH {CTE_RICH} SELECT page_id, url, {TITLE} AS title, {plain("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS headings,
  CAST(CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) AS BIGINT) AS form_count,
  CAST(len(regexp_extract_all({CLEAN}, '<a [^>]*href=')) AS BIGINT) AS link_count,
  CAST(3 * CAST(page_id % 3 = 0 AS INT) + 6 * CAST(page_id % 5 = 0 AS INT) + CAST(page_id % 4 = 0 AS INT) AS BIGINT) AS input_count,
  CAST(CAST(page_id % 3 = 0 AS INT) + 2 * CAST(page_id % 4 = 0 AS INT) AS BIGINT) AS button_count FROM rich""")
def ext_dom_summary(t):
    counts = ["form_count", "link_count", "input_count", "button_count"]
    return structure.dom_summary(t.rich_pages).select(
        "page_id", "url", "title", F.array_join("headings", "|").alias("headings"), *[F.col(c).cast("bigint").alias(c) for c in counts])


@query("ext_prompt_elements", """WITH e AS (SELECT page_id, unnest(list_concat(list_concat(list_concat(list_concat(
  CASE WHEN page_id % 3 = 0 THEN [{'type': 'search', 'name': 'q', 'label': 'Find it', 'required': true, 'text': ''},
    {'type': 'select', 'name': 'sort', 'label': '', 'required': false, 'text': ''}] ELSE [] END,
  CASE WHEN page_id % 5 = 0 THEN [{'type': 'email', 'name': 'email', 'label': '', 'required': false, 'text': ''},
    {'type': 'password', 'name': 'pw', 'label': '', 'required': true, 'text': ''}, {'type': 'textarea', 'name': 'note', 'label': '', 'required': false, 'text': ''},
    {'type': 'checkbox', 'name': 'keep', 'label': '', 'required': false, 'text': ''}, {'type': 'radio', 'name': '', 'label': '', 'required': false, 'text': ''},
    {'type': 'submit', 'name': '', 'label': '', 'required': false, 'text': ''}] ELSE [] END),
  CASE WHEN page_id % 4 = 0 THEN [{'type': 'button', 'name': '', 'label': '', 'required': false, 'text': ''}] ELSE [] END),
  list_concat(CASE WHEN page_id % 3 = 0 THEN [{'type': 'button', 'name': '', 'label': '', 'required': false, 'text': 'Go & find'}] ELSE [] END,
    CASE WHEN page_id % 5 = 0 THEN [{'type': 'button', 'name': '', 'label': '', 'required': false, 'text': 'Sign in'}] ELSE [] END)),
  CASE WHEN page_id % 4 = 0 THEN [{'type': 'button', 'name': '', 'label': '', 'required': false, 'text': 'Save all ' || (page_id % 10)},
    {'type': 'button', 'name': '', 'label': '', 'required': false, 'text': 'No'}] ELSE [] END)[1:20]) AS x FROM pages)
  SELECT page_id, x.type AS type, x.name AS name, x.label AS label, x.required AS required, x.text AS text FROM e""")
def ext_prompt_elements(t):
    return structure.prompt_elements(t.rich_pages).drop("position")


@query("ext_doc_page", f"""WITH {CTE_RICH}, s AS (SELECT *, substr(sha256(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(url), '^https?://', ''), '^www\\.', ''), '#.*$', ''), '/$', '')), 1, 16) AS h FROM rich),
  l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY page_id DESC) = 1)
  SELECT page_id, {TITLE} AS title, {plain("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS headings,
  CAST(CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) AS BIGINT) AS forms,
  array_to_string(list_concat(CASE WHEN page_id % 3 = 0 THEN ['Go & find'] ELSE [] END,
    CASE WHEN page_id % 4 = 0 THEN ['Save all ' || (page_id % 10), 'No'] ELSE [] END), '|') AS buttons,
  CAST(len(regexp_extract_all({CLEAN}, '<a [^>]*href=')) AS BIGINT) AS links FROM l""")
def ext_doc_page(t):
    stamped = t.rich_pages.withColumn("url_hash", U.url_hash(F.col("url")))
    # The narrow structure first: what is shuffled to find the newest version holds no page text.
    latest = latest_per_url(structure.doc_page(stamped), order=["page_id"])
    return latest.select(
        "page_id", "title", F.array_join("headings", "|").alias("headings"), F.col("forms").cast("bigint").alias("forms"),
        F.array_join("buttons", "|").alias("buttons"), F.col("links").cast("bigint").alias("links"))


@query("pipe_run", f"""WITH {LINKS}, n AS (SELECT page_id, count(*) AS links FROM out_links
  WHERE NOT regexp_matches(lower(href), '\\.({"|".join(U.DOWNLOAD_EXTENSIONS)})$') GROUP BY page_id)
  SELECT p.page_id, coalesce(links, 0) AS links, lower({TITLE}) AS title,
  CASE WHEN p.page_id % 7 = 3 THEN NULL ELSE p.page_id * 2 END AS twice, CASE WHEN p.page_id % 7 = 3 THEN 'picky,broken' ELSE 'broken' END AS failed FROM pages p LEFT JOIN n USING (page_id)""")
def pipe_run(t):
    def broken(frame):
        return frame.select("no_such_column")

    def picky(page_id):
        if page_id % 7 == 3:
            raise ValueError("not this page")
        return page_id * 2

    out, _ = structure.run_processors(t.rich_pages, [
        ("structure", structure.page_structure), ("links", structure.drop_downloads),
        ("picky", structure.PageStep("twice", ("page_id",), picky, T.LongType())), ("broken", broken),
        ("lower", lambda d: d.withColumn("title", F.lower("title")))])
    return out.select("page_id", F.size("links").cast("bigint").alias("links"), "title", "twice",
                      F.array_join("_failed_processors", ",").alias("failed"))


HOSTILE = """SELECT page_id, url, replace(html, '<article>', concat('<article><p id="planted">n', CAST(page_id AS STRING),
  ' &#1114112;|&#xD800;|&#0;|a&#38;lt;b|caf&eacute;|&amp;amp;|&copy 1|&nosuch;|&#zz;<![foo[x]]>|end</p>')) AS html FROM {pages}"""
MEANT = "'n' || page_id || ' �|�|�|a&lt;b|café|&amp;|© 1|&nosuch;|&#zz;|end'"


def hostile(t):
    """The given pages with references and declarations that break naive readers."""
    return t.spark.sql(HOSTILE, pages=t.pages)


@query("ext_references", f"SELECT page_id, {MEANT} AS text FROM pages")
def ext_references(t):
    planted = F.regexp_extract("html", r'(?s)<p id="planted">(.*?)</p>', 1)
    return hostile(t).select("page_id", H.text_of(planted).alias("text"))


@query("ext_hostile_nodes", f"SELECT page_id, {MEANT} AS text, 'article' AS parent FROM pages")
def ext_hostile_nodes(t):
    """The element tree of such a page: the declaration is skipped and nothing after it is lost."""
    nodes = F.col("nodes")
    found = F.filter(nodes, lambda n: F.try_element_at(n["attrs"], F.lit("id")) == "planted")[0]
    return dom.with_nodes(hostile(t)).select(
        "page_id", found["own"].alias("text"), F.get(nodes, found["parent"])["tag"].alias("parent"))
