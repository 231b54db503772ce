from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.operators import classify, dom, structure

HTML = """<html><head><title> My &amp; Page </title><script>var s = "</p><a href='/no'>no</a>";</script>
<meta name="description" content="one"><meta name='description' content='two'></head>
<body><nav class="main"><a href="/nav">Nav</a></nav><h1>Title</h1><h2> </h2><p>Short<p>Paragraph <b>bold</b> text here.
<ul><li>One<li>Two</ul><!-- <a href="/hidden">x</a> --><a href="/about#top">About <i>Us</i></a><a href='/about/'>Again</a>
<a href="https://o.com/x" hidden>h</a><a href="mailto:a@b">m</a>
<form action="go" id=f><label for="n">Your <b>name</b></label><input id="n" name=name required><input type=password name="pw">
<select name=s><option value=a>A<option value=b selected>B</select><textarea name=t>hi</textarea><button>Send</button></form>
<div role="button" tabindex="0">Menu</div><pre>code</pre><blockquote>quote</blockquote>
<div class="modal-x"><p>Not this paragraph text.</p></div></body></html>"""


def one(spark, *columns):
    rows = spark.createDataFrame([(1, "https://e.com/dir/page", HTML)], "page_id long, url string, html string")
    return structure.staged(rows).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_flat_structure(spark):
    bare, url = F.col("bare"), F.col("url")
    row = one(spark, H.title(bare), H.links_from(H.raw_links(bare), url), H.headings(bare), H.meta(bare), H.forms(bare, url),
              H.buttons(bare), H.form_fields(bare))
    assert row.c0 == "My & Page"
    assert [(l.href, l.text) for l in row.c1] == [("https://e.com/nav", "Nav"), ("https://e.com/about", "About Us")]
    assert [(h.level, h.text) for h in row.c2] == [(1, "Title")]
    assert row.c3 == {"description": "two"}
    form = row.c4[0]
    assert (form.action, form.method) == ("https://e.com/dir/go", "GET")
    assert [(i.name, i.type, i.required) for i in form.inputs] == [
        ("name", "input", True), ("pw", "password", False), ("s", "select", False), ("t", "textarea", False)]
    assert [b.text for b in row.c5] == ["Send", "Menu"]
    assert [(f.kind, f.label, f.value) for f in row.c6] == [
        ("input", "Your name", ""), ("input", "pw", ""), ("select", "s", "b"), ("textarea", "t", "hi"), ("button", "Send", "")]


def test_entities(spark):
    row = spark.range(1).select(
        H.decode_entities(F.lit("&lt;&#39;&#x1F600;&#233;&copy;&amp;lt; &#zz;")).alias("a"), H.text_of(F.lit(" <b>x</b>&nbsp;y ")).alias("b")).first()
    assert row.a == "<'😀é©&lt; &#zz;"
    assert row.b.split() == ["x", "y"]


def test_tree(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", HTML)], "page_id long, url string, html string")
    row = dom.with_nodes(pages).select(
        dom.markdown(F.col("nodes")).alias("md"), dom.cleaned_html(F.col("html"), F.col("nodes")).alias("clean")).first()
    lines = row.md.split("\n")
    assert lines[0] == "# Title"
    assert "Paragraph  text here." in row.md and "Not this" not in row.md and "Nav" not in row.md
    assert "- One" in lines and "- Two" in lines and "[About](/about#top)" in lines and "> quote" in lines
    assert "```\ncode\n```" in row.md and "\n\n\n" not in row.md
    assert "<script>" not in row.clean and "<nav" not in row.clean and "modal-x" not in row.clean and "Paragraph" in row.clean
    found = dom.elements(pages).orderBy("index").collect()
    assert [e.tag for e in found] == ["a", "a", "a", "a", "a", "input", "input", "select", "textarea", "button", "div"]
    assert found[-1].text == "Menu" and found[1].text == "About Us"
    tree = {r.node_id: r for r in dom.aria_tree(pages).collect()}
    assert tree[0].role == "body" and tree[0].parent_id is None
    assert all(r.parent_id in tree for r in tree.values() if r.node_id)
    assert max(r.depth for r in tree.values()) <= 5


def test_aria_limits(spark):
    deep = "<body>" + "<div>" * 9 + "x" + "</div>" * 9 + "".join(f"<i>{n}</i>" for n in range(30)) + "</body>"
    pages = spark.createDataFrame([(1, "https://e.com/", deep)], "page_id long, url string, html string")
    rows = dom.aria_tree(pages).collect()
    assert max(r.depth for r in rows) == 5
    assert sum(r.role == "i" for r in rows) == 19


def test_classification(spark):
    pages = {
        "<body><a href='https://accounts.google.com/x'>Go</a></body>": "oauth",
        "<body><input type=password><input name=username></body>": "login",
        "<body><input type='password'>Please log in</body>": "login",
        "<body><div class='g-recaptcha'></div></body>": "captcha",
        "<body>Access denied</body>": "blocked",
        "<body>" + "long " * 500 + "forbidden</body>": None,
        "<body>plain</body>": None,
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string").orderBy("i")
    got = rows.select(classify.obstacle(F.col("html"), F.lit("https://e.com/"))["type"]).collect()
    assert [r[0] for r in got] == list(pages.values())
    shields = {"<body><div id='challenge-running'>": "cloudflare", "<body><b class='x ddos-y'>": "ddos-guard", "<body>DDoS protection by X": "ddos-guard",
               "<body><p id=akamai-challenge>": "akamai", "<body>Please wait while we verify": "generic", "<body>ok": None,
               "<body>" + "z" * 1000 + "just a moment": None}
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(shields)], "i int, html string").orderBy("i")
    assert [r[0] for r in rows.select(classify.challenge(F.col("html"))).collect()] == list(shields.values())


def test_processors(spark):
    pages = spark.createDataFrame([(1, "https://e.com/dir/page", HTML + "<a href='/f.pdf'>p</a>")], "page_id long, url string, html string")
    order = []

    def step(name):
        def run(df):
            order.append(name)
            return df
        return run

    def broken(df):
        raise ValueError("boom")

    out, failed = structure.run_processors(pages, [
        ("first", step("first")), ("structure", structure.page_structure), ("broken", broken), ("links", structure.drop_downloads),
        ("last", step("last"))])
    row = out.first()
    assert order == ["first", "last"] and failed == ["broken"] and row._failed_processors == ["broken"]
    assert [l.href for l in row.links] == ["https://e.com/nav", "https://e.com/about"]
    facts = structure.metadata(structure.page_structure(pages)).first().metadata
    assert facts["headingCount"] == "1" and facts["formCount"] == "1" and facts["linkCount"] == "3" and facts["description"] == "two"


def test_sanitize_nested(spark):
    rows = spark.createDataFrame([(("<b>x</b>", 1, ("<i>y</i>",), [" <u>z</u> "]),)], "v struct<a: string, n: int, s: struct<t: string>, l: array<string>>")
    got = rows.select(X.sanitize_nested(F.col("v"), rows.schema["v"].dataType)).first()[0]
    assert (got.a, got.n, got.s.t, got.l) == ("x", 1, "y", ["z"])
