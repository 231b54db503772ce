import random

from pyspark.sql import functions as F

from siteatlas.functions import urls as U
from siteatlas.operators import graph, quality
from siteatlas.sources import robots, sitemaps

BODY = """Disallow: /before
User-agent: *
Disallow: /a
Allow: /a/open
# Disallow: /never
Disallow: /same
Allow: /same
Disallow:
Crawl-delay: 2.5
Sitemap: https://e.com/s.xml
User-agent: Other
Disallow: /other
Sitemap: https://e.com/lost.xml
User-agent: *
User-agent: third
Disallow: /third
"""


def test_robots(spark):
    bodies = spark.createDataFrame([("e.com", BODY)], "host string, body string")
    rules = robots.robots_rules(bodies)
    row = rules.first()
    assert [r.path for r in row.rules] == ["/a", "/same", "/same", "/a/open"]
    assert row.crawl_delay_ms == 2500.0 and row.sitemaps == ["https://e.com/s.xml"]
    urls = spark.createDataFrame([(i, f"https://e.com{p}") for i, p in enumerate(
        ["/a/x", "/a/open/1", "/same", "/other", "/third", "/before", "/"])] + [(9, "https://free.org/a")], "i int, url string")
    got = [r.robots_allowed for r in robots.mark_allowed(urls, rules).orderBy("i").collect()]
    assert got == [False, True, True, True, True, True, True, True]
    mine = robots.robots_rules(bodies, "Third").first().rules
    assert "/third" in [r.path for r in mine]
    assert robots.crawl_delay(rules, 3000).first().delay_ms == 3000.0


def test_sitemaps(spark, tmp_path):
    (tmp_path / "map.xml").write_text("""<urlset><url><loc> https://e.com/a </loc><lastmod>2024-01-02</lastmod><priority>0.0</priority></url>
<url><loc>https://e.com/b</loc><changefreq>daily</changefreq></url><url><loc> </loc></url><url><loc>https://o.org/c</loc><priority>0.9</priority></url>
<url><loc>https://e.com/a</loc><priority>1.0</priority></url></urlset>""")
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(
        f"<sitemap><loc>https://e.com/s{i}.xml</loc></sitemap>" for i in range(12)) + "</sitemapindex>")
    found = sitemaps.read_sitemap(spark, str(tmp_path / "map.xml"))
    assert found.count() == 4
    assert [r.url for r in sitemaps.read_index(spark, str(tmp_path / "index.xml")).orderBy("position").collect()] == [
        f"https://e.com/s{i}.xml" for i in range(10)]
    kept = sitemaps.discovered(found, U.Scope("https://e.com/"), 100).orderBy("url").collect()
    assert [r.url for r in kept] == ["https://e.com/a", "https://e.com/b"]


def test_config(spark):
    configs = {
        '{"name":"n","baseUrl":"https://e.com","scope":{"maxDepth":5}}': [],
        '{"name":"n","baseUrl":"https://e.com","scope":{"maxDepth":0,"maxPages":1001}}': [
            "max_depth must be an integer between 1 and 20", "max_pages must be an integer between 1 and 1000"],
        '{"name":"","baseUrl":"nope"}': ["name is required", "Invalid URL: nope"],
        '{"name":"n","baseUrl":"https://e.com","auth":{"type":"email_password","email":"x"}}': [
            "password is required for email_password auth", "Invalid email format: x"],
        '{"name":"n","baseUrl":"https://e.com","auth":{"type":"session"},"output":{"formats":["html","docx"]}}': [
            "session_cookies is required for session auth", "Invalid output format: docx. Must be one of: markdown, html, pdf, word"],
    }
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(configs)], "project_id string, config string")
    got = quality.config_violations(rows).groupBy("project_id").agg(F.collect_list("violation").alias("v")).collect()
    by_id = {r.project_id: r.v for r in got}
    assert [by_id.get(str(i), []) for i in range(len(configs))] == list(configs.values())


def test_section_bounds(spark):
    rows = [(i, f"https://e.com/{s}/{i}", f"T{i}") for i, s in enumerate(["one"] + ["two"] * 2 + ["many"] * 11)] + [(50, "https://o.org/two", "alone")]
    pages = spark.createDataFrame(rows, "seq long, url string, title string")
    found = graph.section_workflows(pages).orderBy("step").collect()
    assert [(r.name, r.step, r.action) for r in found] == [("Two Management", 1, "Navigate to T1"), ("Two Management", 2, "Go to T2")]


def test_many_rules_of_a_host(spark):
    """50,000 rules: the longest matching one decides, looked up by equality."""
    rng = random.Random(2)
    rules = [(f"/{rng.randrange(300)}" + f"/{rng.randrange(300)}" * rng.randrange(2) + "/" * rng.randrange(2), rng.random() < 0.5) for _ in range(50_000)]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {path}" for path, allow in rules)
    bodies = spark.createDataFrame([("e.com", body), ("bare.com", ""), (None, "User-agent: *\nDisallow: /")], "host string, body string")
    paths = [f"/{rng.randrange(310)}/{rng.randrange(310)}" + rng.choice(["", "/x", "/"]) for _ in range(2000)]
    urls = [f"https://e.com{p}" for p in paths] + ["https://bare.com/1", "https://none.com/1", None, "no url"]
    requests = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    last = dict(rules)
    want = []
    for p in paths:
        hits = [p[:n] for n in range(len(p), 0, -1) if p[:n] in last]
        want.append(last[hits[0]] if hits else True)
    marked = robots.mark_allowed(requests, robots.robots_rules(bodies))
    assert [r.robots_allowed for r in marked.orderBy("i").collect()] == [*want, True, True, True, True]
