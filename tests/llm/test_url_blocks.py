"""Block decisions over redirects and canonical links."""

from siteatlas.llm import url_blocks
from siteatlas.llm.common import prepare

PAGES = [
    (1, "http://spam.net/a", '<link rel="canonical" href="http://safe.com/a">'),            # blocked by its own rule
    (2, "http://safe.com/a", ""),                                                              # alias of a blocked page
    (3, "http://other.com/x?id=1", "<META HTTP-EQUIV='Refresh' CONTENT=\"0; URL='http://safe.com/a'\">"),
    (4, "http://example.net/en/x", '<link href="/en/y" rel="canonical nofollow">'),             # allowed, though below net/
    (5, "http://mix.com/1", '<link rel="canonical" href="http://bad.net/1">'),
    (6, "http://mix.com/2", '<link rel="canonical" href="//bad.net/1">'),
    (7, "http://www.mix.org/fr/3", '<link rel="canonical" href="http://bad.net/1">'),           # allowed, so its group is
    (8, "http://example.com/de/z", "<!-- <link rel=canonical href=http://alone.com/> -->"),
    (9, "http://alone.com/", "<link rel=stylesheet href=http://bad.net/1>"),
    (10, "http://deep.com/a/b/c", '<link rel="canonical" href="../d">'),
]
WANT = {1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.net/en/", "allow"), 5: (None, "allow"),
        6: (None, "allow"), 7: ("org/fr/", "allow"), 8: ("example.com/de/", "block"), 9: (None, "allow"), 10: (None, "allow")}


def test_propagation(spark):
    prepare(spark)
    rows = url_blocks.judge_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert {r.id: (r.rule, r.verdict) for r in rows} == WANT


def test_chain_of_redirects(spark):
    prepare(spark)
    chain = [(f"h{i}.com/", f"h{i + 1}.com/") for i in range(40)] + [("h40.com/", "end.net/x")]
    urls = spark.createDataFrame([(i, f"https://h{i}.com/") for i in range(41)], "page_id long, url string")
    rows = url_blocks.judge(urls, spark.createDataFrame(chain, "a string, b string")).collect()
    assert {r.verdict for r in rows} == {"block"} and len(rows) == 41


def test_longest_rule_and_ties(spark):
    rules = (("a.com/", "block"), ("a.com/x/", "allow"), ("b.a.com/", "allow"), ("c.com/", "block"), ("c.com/", "allow"))
    urls = ["http://a.com/x/1", "http://a.com/y", "http://b.a.com/y", "http://ba.com/x/", "http://a.com", "http://c.com/", "http://z.b.a.com/x/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.verdict for r in url_blocks.judge(df, spark.createDataFrame([], "a string, b string"), rules).orderBy("id").collect()]
    assert got == ["allow", "block", "allow", "allow", "allow", "allow", "allow"]


def test_links_written_in_other_ways(spark):
    """Character references, dots and empty paths: the links still name their pages."""
    prepare(spark)
    pages = [(1, "http://a.com/p?a=1&b=2", ""), (2, "http://b.net/1", '<link rel="canonical" href="http://a.com/p?a=1&amp;b=2">'),
             (3, "http://c.com/x", ""), (4, "http://b.net/2", '<link rel="canonical" href="http://c.com/y/../z/.././x">'),
             (5, "http://d.com", ""), (6, "http://b.net/3", '<meta http-equiv="refresh" content="0; url=http&#58;//d.com/">')]
    rows = url_blocks.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.id for r in rows if r.verdict == "block"} == {1, 2, 3, 4, 5, 6}
