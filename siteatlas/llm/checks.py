"""Check SQL (DuckDB) of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from siteatlas.llm import licenses, quality_ledger, url_blocks

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_TEXT_WORDS = f"regexp_extract_all(coalesce(text, ''), {_WORD})"
_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _grams(words: str, size: str, last: str | None = None) -> str:
    """List of all windows of a word list, each joined by a blank."""
    return f"[array_to_string({words}[i:i + {size} - 1], ' ') for i in range(1, len({words}) - {size} + 2)]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, m, k FROM (
  SELECT item_id, least(10, len(w)) AS m, unnest({_grams('w', 'least(10, len(w))')}) AS k FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, m, unnest(range(0, len(w) - m + 1)) AS i, unnest({_grams('w', 'm')}) AS k
  FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, win.m AS m, item_id FROM win JOIN pat ON win.m = pat.m AND win.k = pat.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_TRIM = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LINE_RUNS = rf"""
WITH l AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
c AS (SELECT doc_id, pos, {_TRIM} AS t FROM l WHERE {_TRIM} <> ''),
two AS (SELECT doc_id, pos AS first, lead(pos) OVER w AS last, t || chr(10) || lead(t) OVER w AS k FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT doc_id, first, last, k FROM two WHERE last IS NOT NULL
  UNION ALL SELECT doc_id, pos, pos, t FROM c WHERE len(regexp_extract_all(t, {_WORD})) >= 50),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS r FROM runs) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later)
SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
"""


def _license_sql() -> str:
    values = ", ".join(f"({i}, {_q(name)}, {_q(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+')"
    shingles = f"CASE WHEN len(w) >= 5 THEN {_grams('w', '5')} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH t AS (SELECT DISTINCT n, name, unnest({shingles}) AS k FROM (SELECT n, name, {words} AS w FROM (VALUES {values}) v(n, name, text))),
size AS (SELECT n, name, count(*) AS m FROM t GROUP BY ALL),
d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({shingles}) AS k FROM d),
found AS (SELECT doc_id, n, name FROM (SELECT doc_id, n, count(*) AS c FROM s JOIN t USING (k) GROUP BY ALL) JOIN size USING (n) WHERE c >= 0.8 * m),
listed AS (SELECT doc_id, count(*) AS c, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS templates FROM found GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT doc_id, name FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses,
  coalesce(templates, '') AS templates FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _quality_sql() -> str:
    bits = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(quality_ledger.RULES.values()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_TEXT_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, unnest({_grams('w', '5')}) AS k FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, length(text) AS n_chars, len(l) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  (failed_bits & {quality_ledger.CURRENT.mask}) = 0 AS kept, failed_bits FROM f
"""


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS i, unnest({_grams('w', '20')}) AS k FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
x AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d),
kept AS (SELECT x.doc_id, count(gone.p) AS n, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL), '') AS t
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _url_sql() -> str:
    """Rules, and the closure over canonical links as the pages write them (absolute links, double quotes)."""
    rest = "CASE WHEN contains({u}, '://') THEN {u}[strpos({u}, '://') + 3:] ELSE '' END"
    parts = (f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, "
             "coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query")
    rules = ", ".join(f"({_q(r)}, {_q(r[:r.index('/')])}, {_q(r[r.index('/'):])}, {_q(v)})" for r, v in url_blocks.RULES)
    return f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rules}) r(rule, rule_host, rule_path, verdict)),
p AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(html, ''), '<link rel="canonical" href="([^"]+)"', 1) AS target FROM pages),
u AS (SELECT page_id, host, path, target, host || path || query AS address FROM (
  SELECT page_id, target, {parts} FROM (SELECT page_id, target, {rest.format(u='url')} AS rest FROM p))),
e AS (SELECT address AS a, host || path || query AS b FROM (
  SELECT address, {parts} FROM (SELECT address, {rest.format(u='target')} AS rest FROM u WHERE contains(target, '://')))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
names AS (SELECT address, host, path FROM u UNION SELECT b, split_part(b, '/', 1), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM e),
fit AS (SELECT address, host, path, arg_max(rule, (length(rule), verdict = 'allow')) AS rule, arg_max(rules.verdict, (length(rule), verdict = 'allow')) AS verdict
  FROM names JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
said AS (SELECT reach.a AS address, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reach JOIN fit ON fit.address = reach.b GROUP BY reach.a)
SELECT page_id, u.host, u.path, rule, coalesce(fit.verdict, said.verdict, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.address = fit.address AND u.host = fit.host AND u.path = fit.path LEFT JOIN said ON said.address = u.address
"""


_ALNUM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_ALNUM}) AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), {_ALNUM}) AS w
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT i, item_id, t, count(*) AS qtf FROM (SELECT i, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, size, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS size, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(qtf * CAST(floor(1000 * ln(CAST(2 * c.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * c.n) // c.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

_LETTER = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"


def _share(n: str, size: str, terms: str) -> str:
    return f"CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // ({size} + 5 * {terms}) AS BIGINT)"


DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_LETTER}) AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t FROM t GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, t, count(*) AS n FROM t SEMI JOIN kept USING (lang, t) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.t, coalesce(n.n, 0) AS n, {_share('coalesce(n.n, 0)', 'size', 'v')} AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = kept.t),
l AS (SELECT lang, t, {_share('n', 'size', 'v')} AS q FROM (SELECT lang, t, sum(n) AS n FROM n GROUP BY ALL)
  JOIN (SELECT lang, sum(size) AS size FROM g GROUP BY lang) USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.t AS item, p.p - l.q AS value FROM p JOIN l ON l.lang = p.lang AND l.t = p.t WHERE p.n > 0 AND p.p > l.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms QUALIFY rank <= 50
"""

_CONTROL_KINDS = (r"<\|[^|>]*\|>", "</?s>", "<</?SYS>>", r"\[/?INST\]", r"\\")


def _escaped_size(text: str) -> str:
    return " + ".join([f"len({text})", *[f"len(regexp_extract_all({text}, {_q(kind)}))" for kind in _CONTROL_KINDS]])


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + {_escaped_size('role')} + 3 * len(regexp_extract_all(role, chr(10))) + 1 + {_escaped_size('text')} + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op2_line_runs": LINE_RUNS,
    "op4_licenses": _license_sql(),
    "op5_quality_ledger": _quality_sql(),
    "op6_substrings": SUBSTRINGS,
    "op10_url_blocks": _url_sql(),
    "op11_ranked_search": RANKED,
    "op12_source_divergence": DIVERGENCE,
    "op13_chat_format": CHAT,
}
