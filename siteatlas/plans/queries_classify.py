"""Page classification over the given pages with rule-made parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteatlas.operators import classify
from siteatlas.plans.catalog import CTE_RICH, Tables, query
from siteatlas.plans.queries_extract import BODY_TEXT, TITLE, plain

H1 = plain("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")


@query("cls_obstacle", """SELECT page_id, CASE WHEN page_id % 13 = 2 THEN 'oauth' WHEN page_id % 5 = 0 THEN 'login'
    WHEN page_id % 12 = 5 THEN 'captcha' ELSE '' END AS type, CASE WHEN page_id % 13 = 2 THEN 'google' ELSE '' END AS providers,
  CASE WHEN page_id % 13 = 2 THEN 'OAuth/SSO login detected (google). Please sign in using the browser window.' WHEN page_id % 5 = 0
    THEN 'Login page detected. Please log in.' WHEN page_id % 12 = 5 THEN 'CAPTCHA detected.' ELSE '' END AS message FROM pages""")
def cls_obstacle(t: Tables):
    found = t.rich_pages.select("page_id", classify.obstacle(F.col("html"), F.col("url")).alias("o"))
    return found.select("page_id", F.coalesce("o.type", F.lit("")).alias("type"),
                        F.coalesce(F.array_join("o.providers", ","), F.lit("")).alias("providers"),
                        F.coalesce("o.message", F.lit("")).alias("message"))


@query("cls_challenge", "SELECT page_id, CASE WHEN page_id % 12 = 7 THEN 'cloudflare' END AS challenge FROM pages")
def cls_challenge(t):
    return t.rich_pages.select("page_id", classify.challenge(F.col("html")).alias("challenge"))


@query("cls_session", f"""WITH {CTE_RICH}, s AS (SELECT *, CASE WHEN page_id % 20 = 1 THEN 401 WHEN page_id % 20 = 2 THEN 403 ELSE 200 END AS status,
    CASE WHEN page_id % 16 = 3 THEN 'https://example.com/Login?next=x' ELSE url END AS final_url FROM rich)
  SELECT page_id, CASE status WHEN 401 THEN 'http_401' WHEN 403 THEN 'http_403' ELSE CASE WHEN page_id % 16 = 3 OR (page_id % 5 = 0
    AND regexp_matches({BODY_TEXT}, 'sign in|log in|login')) THEN 'login_redirect' ELSE 'valid' END END AS state FROM s""")
def cls_session(t):
    status = F.when(F.col("page_id") % 20 == 1, 401).when(F.col("page_id") % 20 == 2, 403).otherwise(200)
    final = F.when(F.col("page_id") % 16 == 3, "https://example.com/Login?next=x").otherwise(F.col("url"))
    return t.rich_pages.select("page_id", classify.session_state(F.col("html"), final, status).alias("state"))


@query("cls_logged_in", "SELECT page_id, page_id % 14 = 9 AS logged_in FROM pages")
def cls_logged_in(t):
    return t.rich_pages.select("page_id", classify.logged_in(F.col("html")).alias("logged_in"))


USERS = f"""array_to_string(list_filter([CASE WHEN regexp_matches({BODY_TEXT}, 'admin|manage') THEN 'Administrators' END,
  CASE WHEN regexp_matches({BODY_TEXT}, 'dashboard|analytics') THEN 'Managers' END, CASE WHEN regexp_matches({BODY_TEXT}, 'settings|profile') THEN 'All users' END,
  CASE WHEN regexp_matches({BODY_TEXT}, 'register|sign up') THEN 'New users' END], lambda x: x IS NOT NULL), ',')"""


@query("cls_target_users", f"WITH {CTE_RICH} SELECT page_id, coalesce(nullif({USERS}, ''), 'General users') AS users FROM rich")
def cls_target_users(t):
    return t.rich_pages.select("page_id", F.array_join(classify.target_users(F.col("html")), ",").alias("users"))


# What the rules of rich pages imply for the structural analysis.
STRUCTURAL = f"""SELECT page_id, {TITLE} || ' - ' || {H1} AS page_purpose,
  array_to_string(list_concat(list_concat(list_concat(list_concat(
    CASE WHEN page_id % 3 = 0 THEN ['[name="q"]: Find it (search field): Enter find it', '[name="sort"]: sort (select field): Select an option'] ELSE [] END,
    CASE WHEN page_id % 5 = 0 THEN ['[name="email"]: Email (email field): Enter email', '[name="pw"]: pw (password field): Enter pw',
      '[name="note"]: note (textarea field): Enter note', '[name="keep"]: keep (checkbox field): Enter keep'] ELSE [] END),
    CASE WHEN page_id % 3 = 0 THEN ['button: "Go & find" button: Click "Go & find"'] ELSE [] END),
    CASE WHEN page_id % 5 = 0 THEN ['button: "Sign in" button: Click "Sign in"'] ELSE [] END),
    CASE WHEN page_id % 4 = 0 THEN ['button: "Save all ' || (page_id % 10) || '" button: Click "Save all ' || (page_id % 10) || '"',
      'button: "Button" button: Click "Button"', 'button: "No" button: Click "No"'] ELSE [] END), '|') AS elements,
  array_to_string(list_concat(['Navigate to ' || {TITLE}, 'Review "' || {H1} || '" section'],
    CASE WHEN page_id % 3 = 0 THEN ['Fill in "Find it"', 'Fill in "sort"', 'Click "Go & find"']
      WHEN page_id % 5 = 0 THEN ['Fill in "email"', 'Fill in "pw"', 'Fill in "note"', 'Fill in "keep"', 'Click "Submit"'] ELSE [] END), '|') AS steps,
  array_to_string(list_concat(CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN [(CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT)) || ' required field(s) must be filled'] ELSE [] END,
    CASE WHEN page_id % 5 = 0 THEN ['Password field present - ensure password meets requirements', 'Email field requires valid email format'] ELSE [] END), '|') AS common_issues FROM rich"""


def flat_analysis(frame):
    """The analysis struct ``a`` as text columns."""
    return frame.select(
        "page_id", F.col("a.page_purpose").alias("page_purpose"),
        F.array_join(F.transform("a.elements", lambda e: F.concat_ws(": ", e["selector"], e["description"], e["user_action"])), "|").alias("elements"),
        F.array_join("a.steps", "|").alias("steps"), F.array_join("a.common_issues", "|").alias("common_issues"))


@query("cls_structural", f"WITH {CTE_RICH} {STRUCTURAL}")
def cls_structural(t):
    return flat_analysis(t.rich_pages.select("page_id", classify.structural_analysis(F.col("html"), F.lit("")).alias("a")))
