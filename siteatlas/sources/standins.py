"""Relations the given tables lack, derived from them row by row.

Each is one SQL text over a named table, written in the subset both engines
read, so the Spark job and its check start from the same rows.
"""

from __future__ import annotations

CRAWL_EVENTS = """
SELECT event_id AS seq, ts AS event_time, user_id,
       concat('site', CAST(user_id % 20 AS STRING), '.example.com') AS domain,
       concat('https://site', CAST(user_id % 20 AS STRING), '.example.com/p/', CAST(event_id % 50 AS STRING)) AS url,
       concat('s', CAST(user_id % 7 AS STRING)) AS session_id,
       CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'error' THEN 'failure'
            WHEN 'signup' THEN 'skip' ELSE 'challenge' END AS kind,
       value * 10 AS duration_ms,
       CASE WHEN event_id % 3 = 0 THEN 'TimeoutError' ELSE 'Error' END AS error_type,
       CASE WHEN event_id % 5 = 0 THEN 'HTTP 429 Rate Limit' WHEN event_id % 7 = 0 THEN 'net::ERR_ABORTED'
            ELSE concat('no answer after ', CAST(event_id % 13 AS STRING), ' s') END AS error_message,
       CAST(event_id % 4 AS INT) AS retry_count, CAST(user_id % 11 AS INT) AS priority
FROM {events}
"""

SNAPSHOTS = """
SELECT doc_id AS seq, concat('snap', CAST(doc_id AS STRING)) AS snapshot_id, source AS project_id,
       concat('https://', source, '.example.com/d/', CAST(doc_id % 100 AS STRING)) AS page_url,
       text AS html, n_chars, lang,
       CAST(1704067200000000 + doc_id * 60000000 AS BIGINT) AS captured_us,
       CASE WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS http_status
FROM {documents}
"""

RICH_HEAD = """concat(
  '<link rel="canonical" href="/c/', CAST(page_id % 40 AS STRING), '">',
  '<link rel="alternate" hreflang="de" href="/de/', CAST(page_id % 30 AS STRING), '">',
  '<link rel="alternate" hreflang="fr" href="https://fr.example.com/x">',
  CASE WHEN page_id % 2 = 0 THEN concat('<link rel="next" href="?page=', CAST(page_id % 7 + 1 AS STRING), '">') ELSE '' END,
  CASE WHEN page_id % 6 = 1 THEN concat('<meta http-equiv="refresh" content="5; url=/moved/', CAST(page_id % 8 AS STRING), '">') ELSE '' END,
  '<meta name="description" content="first"><meta name="description" content="About &amp; more ', CAST(page_id % 12 AS STRING), '">',
  '<meta property="og:type" content="article"><meta name="empty" content="">',
  CASE WHEN page_id % 9 = 4 THEN '<script src="/static/chunk.7.js"></script>' ELSE '' END,
  '<link rel="stylesheet" href="/a.css">')"""

RICH_BODY = """concat(
  CASE WHEN page_id % 3 = 0 THEN concat('<form action="/search/', CAST(page_id % 11 AS STRING), '" method="get">',
    '<label for="q', CAST(page_id AS STRING), '">Find <i>it</i></label>',
    '<input id="q', CAST(page_id AS STRING), '" name="q" type="search" required placeholder="Search">',
    '<select name="sort"><option value="">-</option><option value="new" selected>New</option></select>',
    '<input type="hidden" name="tok" value="x"><button type="submit">Go &amp; find</button></form>') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<form method="post"><input type="email" name="email" aria-label="Email">',
    '<input type="password" name="pw" required><textarea name="note">n', CAST(page_id % 4 AS STRING), '</textarea>',
    '<input type="checkbox" name="keep"><input type="radio"><input type="submit" value="Sign in"></form>') ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('<button class="x">Save <b>all ', CAST(page_id % 10 AS STRING), '</b></button>',
    '<div role="button" aria-label="Menu"></div><input type="button" value="Reset"><button hidden>No</button>') ELSE '' END,
  CASE WHEN page_id % 7 = 0 THEN concat('<a href="#/r/', CAST(page_id % 9 AS STRING), '">R</a><a href="#!/s">S</a>',
    '<div data-route="/dr/', CAST(page_id % 6 AS STRING), '">D</div>',
    '<script>var r=["/route-', CAST(page_id % 5 AS STRING), '","/route/b"];</script>') ELSE '' END,
  CASE WHEN page_id % 8 = 3 THEN concat('<div class="pagination"><a href="/p/1">1</a><span class="active">',
    CAST(page_id % 5 AS STRING), '</span><a href="/p/3">3</a></div>') ELSE '' END,
  CASE WHEN page_id % 10 = 6 THEN '<p>404 this page was not found</p>' WHEN page_id % 10 = 7 THEN '<p>Please sign in to manage settings</p>' ELSE '' END,
  CASE WHEN page_id % 12 = 5 THEN '<div class="g-recaptcha"></div>' WHEN page_id % 12 = 7 THEN '<div id="challenge-form">Just a moment</div>' ELSE '' END,
  CASE WHEN page_id % 13 = 2 THEN '<a href="https://accounts.google.com/o">Continue with Google</a>' ELSE '' END,
  CASE WHEN page_id % 14 = 9 THEN '<a class="user-menu" href="/logout">Log out</a>' ELSE '' END)"""

RICH_PAGES = f"""
SELECT page_id, url,
       replace(replace(html, '</head>', concat({RICH_HEAD}, '</head>')), '<article>', concat({RICH_BODY}, '<article>')) AS html
FROM {{pages}}
"""

# URL shapes the page table lacks, one list per page: deep paths, identifiers,
# parameter soup, ports, redirectors, downloads, trackers, other schemes.
URL_SHAPES = """
  url,
  concat('https://example.com/docs/a', CAST(page_id % 5 AS STRING), '/b/c/d/page/', CAST(page_id % 12 AS STRING), '/'),
  concat('https://example.com/p/', CAST(page_id AS STRING), '?z=1&Utm_Source=a&b=', CAST(page_id % 3 AS STRING), '&A=2&flag&sid=9&trkInfo=k'),
  concat('HTTP://WWW.Example.COM:80/Shop/', CAST(page_id % 9 AS STRING), '/#top'),
  concat('https://example.com/docs/0f8fad5b-d9cd-469f-a165-70867728950e/v', CAST(page_id % 4 AS STRING)),
  concat('https://example.com/docs/abf1ad5bd9cd469fa16570867728950e/', CAST(page_id AS STRING), ':8', CAST(page_id % 3 AS STRING)),
  concat('https://example.com/go?next=%2Fdash&token=abc&q=', CAST(page_id AS STRING), repeat('k', 51)),
  concat('https://cdn.example.com:8443/files/r', CAST(page_id % 20 AS STRING), '.PDF'),
  concat('https://www.google-analytics.com/collect/', CAST(page_id % 6 AS STRING)),
  concat('https://fonts.example.net/f', CAST(page_id % 6 AS STRING), '.woff2'),
  concat('https://example.com/account/login?page=', CAST(page_id % 30 AS STRING)),
  concat('mailto:u', CAST(page_id AS STRING), '@example.com'),
  concat('javascript:void(', CAST(page_id AS STRING), ')'),
  concat('not a url ', CAST(page_id AS STRING)),
  'https://example.com',
  concat('https://example.com/docs/x?u=javascript:', CAST(page_id AS STRING))
"""
