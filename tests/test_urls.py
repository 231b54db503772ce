import random
import re

from pyspark.sql import functions as F

from siteatlas.functions import literals
from siteatlas.functions import text as X
from siteatlas.functions import urls as U


def ask(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("u"))).collect()]


def test_normalize(spark):
    shop = "https://shop.test"
    cases = {
        f"{shop}/cart#items": f"{shop}/cart",
        f"{shop}/cart/": f"{shop}/cart",
        f"{shop}/": f"{shop}/",
        shop: f"{shop}/",
        f"{shop}/list?utm_term=red&gclid=7&size=9": f"{shop}/list?size=9",
        f"{shop}/list?size=9&colour=red": f"{shop}/list?colour=red&size=9",
        f"{shop}/list/?n=4": f"{shop}/list/?n=4",
        f"{shop}/list?sale&brand=a%20b": f"{shop}/list?brand=a+b&sale=",
        f"{shop}/list?trkInfo=1&PHPSESSID=2&SID=3": f"{shop}/list?PHPSESSID=2&trkInfo=1",
        "HTTPS://SHOP.test:443/Big": f"{shop}/Big",
        "two words": "two words",
    }
    assert ask(spark, list(cases), U.normalize) == list(cases.values())
    assert ask(spark, [f"{shop}/a?trkInfo=1&PHPSESSID=2"], lambda u: U.normalize(u, True)) == [f"{shop}/a"]


def test_predicates(spark):
    listed = {"https://news.test/archive/page/14": True, "https://news.test/find?page=9": True, "https://news.test/feed?offset=60": True,
              "https://news.test/imprint": False, "https://news.test/archive/a-long-night": False}
    assert ask(spark, list(listed), U.is_pagination) == list(listed.values())
    hops = {"https://id.test/in?redirect=https%3A%2F%2Fnews.test": True, "https://id.test/in?next=/home": True,
            "https://id.test/in?goto=/start": True, "https://id.test/redirect/x": True, "https://id.test/goto/x": True, "https://id.test/terms": False}
    assert ask(spark, list(hops), U.is_redirector) == list(hops.values())
    files = {"https://f.test/plan.PDF": True, "https://f.test/plan.pdf?v=2": False, "https://f.test/setup.exe": True, "https://f.test/plans": False}
    assert ask(spark, list(files), U.is_download) == list(files.values())


def test_scope(spark):
    def allowed(scope, **expected):
        names = list(expected)
        where = {"root": "https://wiki.test/", "manual": "https://wiki.test/manual", "intro": "https://wiki.test/manual/intro",
                 "setup": "https://wiki.test/manual/setup/linux", "beside": "https://wiki.test/manual2/x", "far": "https://wiki.test/manual/1/2/3/4",
                 "team": "https://wiki.test/team/jobs", "host": "https://forum.test/t/5", "sub": "https://old.wiki.test/manual", "none": "",
                 "words": "see below", "script": "javascript:alert(1)", "mail": "mailto:crew@wiki.test"}
        got = ask(spark, [where[n] for n in names], lambda u: U.in_scope(u, scope)["allowed"])
        assert dict(zip(names, got)) == expected

    allowed(U.Scope("https://wiki.test/manual"), root=True, intro=True, team=True, host=False, sub=False, none=False, words=False,
            script=False, mail=False)
    allowed(U.Scope("https://wiki.test/manual", "depth_only", 3), manual=True, intro=True, setup=True, beside=True, far=False, team=False, root=False)
    allowed(U.Scope("https://wiki.test", "full"), host=True, team=True, script=False, mail=False)
    allowed(U.Scope("https://wiki.test", include=("/manual/", "/setup/")), intro=True, setup=True, team=False)
    allowed(U.Scope("https://wiki.test", exclude=("/team/", "/setup/")), root=True, team=False, setup=False)
    allowed(U.Scope("https://wiki.test", "sideways"), root=False)


def test_relative_depth(spark):
    urls = ["https://wiki.test/manual", "https://wiki.test/manual/intro", "https://wiki.test/manual/setup/linux", "see below"]
    assert ask(spark, urls, lambda u: U.relative_depth(u, "https://wiki.test/manual")) == [0, 1, 2, -1]


def test_pattern_keeps_its_quirks(spark):
    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    urls = ["https://e.com/12abc", f"https://e.com/a{uuid[1:]}", f"https://e.com/{uuid}", "https://e.com/x/:77", "bad"]
    got = ask(spark, urls, U.pattern)
    assert got == ["https://e.com/:idabc", "https://e.com/:uuid", f"https://e.com/:id{uuid[1:]}", "https://e.com/x//:num", None]


def test_resolve(spark):
    base = F.lit("https://e.com/a/b/c?q=1#f")
    cases = {"../x": "https://e.com/a/x", "./y": "https://e.com/a/b/y", "/z/../w": "https://e.com/w", "//h.org/p": "https://h.org/p",
             "?k=v": "https://e.com/a/b/c?k=v", "#t": "https://e.com/a/b/c?q=1#t", "": "https://e.com/a/b/c?q=1", "mailto:a@b": "mailto:a@b",
             "http://o.com": "http://o.com/", "../../../..": "https://e.com/"}
    assert ask(spark, list(cases), lambda u: U.resolve(u, base)) == list(cases.values())


def test_text(spark):
    assert ask(spark, ["<b>a</b> &lt;i&gt; &amp;lt; "], X.strip_html) == ["a <i> &lt;"]
    assert ask(spark, ["Hello, World!  Again", "-a-"], X.slug) == ["hello-world-again", "-a-"]
    assert ask(spark, ["a  b\nc", "x" * 12], lambda u: X.truncate(u, 10)) == ["a b c", "x" * 7 + "..."]
    assert ask(spark, ["Plan (v1.2)_x", "bad#", ""], X.is_valid_name) == [True, False, False]
    assert ask(spark, ["net::ERR_ABORTED at x", "Invalid URL", "Protocol error (Page)", "timeout"],
               lambda m: X.is_retryable(F.lit(0), m)) == [False, False, False, True]
    assert ask(spark, ["timeout"], lambda m: X.is_retryable(F.lit(2), m)) == [False]
    assert ask(spark, ["0", "1", "2"], lambda n: X.backoff_ms(n.cast("int"))) == [2000.0, 4000.0, 8000.0]
    assert ask(spark, ["", "0.0", "1.0", "0.5", "0.8"], lambda p: X.sitemap_priority(p.try_cast("double"))) == [10, 10, 0, 10, 4]


def test_any_of_many_literals():
    rng = random.Random(5)
    chars = "ab/.?*+()[]{}|\\^$ é#\n-"
    for _ in range(60):
        parts = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 30))]
        body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), literals.any_of(parts))
        for _ in range(30):
            text = "".join(rng.choice(chars) for _ in range(rng.randrange(0, 12)))
            assert bool(re.search(body, text)) == any(p in text for p in parts), (parts, text)


def test_thousands_of_patterns_are_one_expression(spark):
    """10,000 literals and 100 expressions, invalid ones among them: the plan has no branch for each."""
    rng = random.Random(6)
    texts = [f"/{rng.randrange(10**6)}/{'é' * (i % 2)}x[{i % 7}]" for i in range(9_990)] + ["/[/"]
    patterns = (*texts, *[rf"/\/q{i}\d+$/" for i in range(99)], r"/(a)\1z/")
    urls = [f"https://e.com{rng.choice(texts)}?{i}" for i in range(200)] + [f"https://e.com/q{i}5" for i in range(0, 200, 3)] + [
        "https://e.com/aaz", "https://e.com/az", "https://e.com/none", "https://e.com/[/", None]

    def wanted(url):
        found = [re.search(rf"/q{i}\d+$", url) for i in range(99)] if url else []
        return None if url is None else any(t in url for t in texts) or any(found) or "aaz" in url

    rows = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    found = rows.select("i", U.matches_any(F.col("url"), patterns).alias("hit"))
    assert [r.hit for r in found.orderBy("i").collect()] == [wanted(u) for u in urls]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 3 and "Contains" not in plan
