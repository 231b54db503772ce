"""Steps that need the element tree of a page.

One small Arrow function numbers the elements of a page; it decides nothing
about their meaning.  Everything that is asked of the tree is an expression
over the numbered array, so selection, cleaning and rendering stay in the JVM.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.functions.bind import let

# ---- fixed values -----------------------------------------------------------
VOID_TAGS = ["input", "img", "br", "hr", "meta", "link", "area", "base", "col", "embed", "source",
             "track", "wbr"]
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg", "nav", "footer", "header"]
NOISE_ROLES = ["navigation", "banner", "contentinfo"]
NOISE_CLASSES = ["cookie", "popup", "modal", "overlay", "sidebar", "menu", "nav"]
NOISE_IDS = ["cookie", "popup", "modal"]
INTERACTIVE_TAGS = ["button", "input", "select", "textarea"]
INTERACTIVE_ROLES = ["button", "link", "tab", "menuitem", "checkbox", "radio", "switch", "slider",
                     "combobox", "searchbox", "textbox"]
PLAIN_ROLES = ["button", "link", "textbox"]
KEPT_ATTRIBUTES = ["type", "name", "placeholder", "href", "role", "aria-label", "aria-describedby",
                   "value", "title", "alt", "for", "action", "method"]
SHOWN_ATTRIBUTES = ["type", "name", "placeholder", "href", "aria-label", "value", "title", "alt"]
# -----------------------------------------------------------------------------

# Start tags that end an open paragraph, whatever inline elements it holds, and
# the elements that search stops at.
ENDS_P = set(H.BLOCK_TAGS.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|")) - {"td", "th", "tr", "body", "html"}
P_BOUNDS = {"button", "table", "td", "th", "caption", "html", "body", "object", "template"}
# Start tags that end an open element of the key's kind (HTML's optional end tags).
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "head": {"body"},
}

NODE = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("nth", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("own", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_ARROW_NODE = pa.struct([
    ("pos", pa.int32()), ("parent", pa.int32()), ("nth", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()),
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own", pa.string()),
    ("start", pa.int32()), ("stop", pa.int32())])


class _Numberer(HTMLParser):
    """Numbers the elements of one page in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.lines = [0]
        at = html.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = html.find("\n", at + 1)
        self.size = len(html)
        self.source = html
        self.feed(html)
        self.close()
        self._end(0, self.size)

    def parse_marked_section(self, i, report=1):
        """``<![...``: a bogus comment in HTML, whatever it holds."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, level: int, stop: int) -> None:
        for node in self.open[level:]:
            node["stop"], node["last"] = stop, len(self.nodes) - 1
        del self.open[level:]

    def handle_starttag(self, tag, attrs):
        at = self._here()
        if tag in ENDS_P:
            for level in range(len(self.open) - 1, -1, -1):
                if self.open[level]["tag"] == "p":
                    self._end(level, at)
                    break
                if self.open[level]["tag"] in P_BOUNDS:
                    break
        while self.open and tag in ENDED_BY.get(self.open[-1]["tag"], ()):
            self._end(len(self.open) - 1, at)
        parent = self.open[-1] if self.open else None
        node = {"pos": len(self.nodes), "parent": parent["pos"] if parent else -1,
                "nth": parent["kids"] if parent else 0, "depth": len(self.open), "tag": tag,
                "attrs": list({k: v or "" for k, v in reversed(attrs)}.items()), "own": [], "kids": 0,
                "start": at, "stop": at + len(self.get_starttag_text()), "last": len(self.nodes)}
        if parent:
            parent["kids"] += 1
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for level in range(len(self.open) - 1, -1, -1):
            if self.open[level]["tag"] == tag:
                at = self._here()
                self._end(level + 1, at)
                self._end(level, self.source.find(">", at) + 1 or self.size)
                return

    def handle_data(self, data):
        if self.open:
            self.open[-1]["own"].append(data)


def _number(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    return [{**n, "own": "".join(n["own"])} for n in _Numberer(html).nodes]


@F.arrow_udf(T.ArrayType(NODE))
def element_nodes(pages: pa.Array) -> pa.Array:
    """Numbered elements of each page."""
    return pa.array([_number(p.as_py()) for p in pages], type=pa.list_(_ARROW_NODE))


def with_nodes(pages: DataFrame) -> DataFrame:
    return pages.withColumn("nodes", element_nodes(F.col("html")))


def _attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def _holds_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def source_text(html: Column, node: Column) -> Column:
    """Text content of a node, read from its source span."""
    return H.text_of(H.drop_scripts(F.substring(html, node["start"] + 1, node["stop"] - node["start"])))


def is_noise(node: Column) -> Column:
    return (node["tag"].isin(NOISE_TAGS) | _attr(node, "role").isin(NOISE_ROLES)
            | _holds_any(_attr(node, "class"), NOISE_CLASSES) | _holds_any(_attr(node, "id"), NOISE_IDS))


def _outermost(nodes: Column) -> Column:
    """Nodes of the array that lie in no other node of it (document order)."""
    return let(nodes, lambda all_of: F.filter(all_of, lambda n, i: ~F.exists(
        F.slice(all_of, F.lit(1), i), lambda m: m["last"] >= n["pos"])))


def cleaned_html(html: Column, nodes: Column) -> Column:
    """HTML without noise subtrees: the source minus their spans."""
    def edge(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"))

    def between(edges: Column) -> Column:
        kept = F.transform(F.slice(edges, F.lit(2), F.size(edges) - 1), lambda e, i: F.substring(
            html, edges[i]["stop"] + 1, e["start"] - edges[i]["stop"]))
        return F.array_join(kept, "")

    cut = F.transform(_outermost(F.filter(nodes, is_noise)), lambda n: edge(n["start"], n["stop"]))
    return let(F.concat(F.array(edge(F.lit(0), F.lit(0))), cut, F.array(edge(F.length(html), F.length(html)))), between)


def body_node(nodes: Column) -> Column:
    return H.first_where(nodes, lambda n: n["tag"] == "body")


def content_nodes(nodes: Column, drop_noise: bool = True) -> Column:
    """Nodes below body that are kept, in document order."""
    def unwanted(n: Column) -> Column:
        return is_noise(n) if drop_noise else n["tag"].isin("script", "style", "noscript")

    dropped = F.transform(_outermost(F.filter(nodes, unwanted)), lambda n: F.struct(
        n["pos"].alias("pos"), n["last"].alias("last")))
    return let(body_node(nodes), lambda body: let(dropped, lambda gone: F.filter(
        nodes, lambda n: (n["pos"] > body["pos"]) & (n["pos"] <= body["last"]) & ~F.exists(
            gone, lambda d: (d["pos"] <= n["pos"]) & (n["pos"] <= d["last"])))))


def markdown(nodes: Column, drop_noise: bool = True) -> Column:
    """Own text of headings, paragraphs, items, links, code and quotes."""
    def line(n: Column, text: Column) -> Column:
        tag = n["tag"]
        shown = F.when(tag.isin("h1", "h2", "h3", "h4"), F.concat(
            F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), text, F.lit("\n")))
        shown = shown.when((tag == "p") & (F.length(text) > 10), F.concat(text, F.lit("\n")))
        shown = shown.when(tag == "li", F.concat(F.lit("- "), text))
        shown = shown.when((tag == "a") & (_attr(n, "href") != ""), F.concat(
            F.lit("["), text, F.lit("]("), _attr(n, "href"), F.lit(")")))
        shown = shown.when(tag.isin("code", "pre"), F.concat(F.lit("```\n"), text, F.lit("\n```\n")))
        shown = shown.when(tag == "blockquote", F.concat(F.lit("> "), text, F.lit("\n")))
        return F.when(text != "", shown)

    lines = F.array_compact(F.transform(
        content_nodes(nodes, drop_noise), lambda n: let(X.trimmed(n["own"]), lambda text: line(n, text))))
    return X.trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def aria_tree(pages: DataFrame, max_depth: int = 5, max_children: int = 20) -> DataFrame:
    """(page_id, node_id, parent_id, depth, role, label) below and with body."""
    nodes = F.col("nodes")

    def shown(n: Column, body: Column) -> Column:
        """Each ancestor up to body is among its parent's first children."""
        keep, at = F.lit(True), n
        for _ in range(max_depth):
            keep = keep & ((at["pos"] <= body["pos"]) | (at["nth"] < max_children))
            at = F.get(nodes, at["parent"])
        return F.coalesce(keep, F.lit(True))

    def row(n: Column, body: Column) -> Column:
        return F.struct(
            (n["pos"] - body["pos"]).alias("node_id"),
            F.when(n["pos"] > body["pos"], n["parent"] - body["pos"]).alias("parent_id"),
            (n["depth"] - body["depth"]).alias("depth"),
            F.coalesce(H.or_null(_attr(n, "role")), n["tag"]).alias("role"),
            X.trimmed(F.coalesce(H.or_null(_attr(n, "aria-label")), H.or_null(_attr(n, "alt")),
                                 F.substring(source_text(F.col("html"), n), 1, 100))).alias("label"))

    rows = let(body_node(nodes), lambda body: F.transform(F.filter(
        nodes, lambda n: (n["pos"] >= body["pos"]) & (n["pos"] <= body["last"])
        & (n["depth"] - body["depth"] <= max_depth) & shown(n, body)), lambda n: row(n, body)))
    return with_nodes(pages).select("page_id", F.inline(rows))


def interactive(nodes: Column, limit: int = 500) -> Column:
    def wanted(n: Column) -> Column:
        attrs = n["attrs"]
        return (n["tag"].isin(INTERACTIVE_TAGS) | ((n["tag"] == "a") & F.map_contains_key(attrs, "href"))
                | _attr(n, "role").isin(INTERACTIVE_ROLES)
                | F.coalesce(F.try_element_at(attrs, F.lit("contenteditable")).isin("true", ""), F.lit(False))
                | (F.map_contains_key(attrs, "tabindex") & (_attr(n, "tabindex") != "-1")))

    return F.slice(F.filter(nodes, wanted), 1, limit)


def elements(pages: DataFrame, limit: int = 500, max_text: int = 100) -> DataFrame:
    """(page_id, index, tag, role, attributes, text): numbered interactive elements."""
    return _with_elements(pages, limit, max_text).select("page_id", F.inline("elements"))


def _with_elements(pages: DataFrame, limit: int, max_text: int) -> DataFrame:
    rows = F.transform(interactive(F.col("nodes"), limit), lambda n, i: F.struct(
        (i + 1).alias("index"), n["tag"].alias("tag"), _attr(n, "role").alias("role"),
        F.map_filter(n["attrs"], lambda k, v: k.isin(KEPT_ATTRIBUTES) & (v != "")).alias("attributes"),
        X.truncate(F.substring(source_text(F.col("html"), n), 1, max_text), max_text).alias("text")))
    return with_nodes(pages).select("page_id", rows.alias("elements"))


def elements_text(pages: DataFrame, limit: int = 500, max_text: int = 100) -> DataFrame:
    """One compact text per page, a line per element, with the element count."""
    def line(e: Column) -> Column:
        parts = [F.when((e["role"] != "") & ~e["role"].isin(PLAIN_ROLES),
                        F.concat(F.lit('role="'), e["role"], F.lit('"')))]
        for name in SHOWN_ATTRIBUTES:
            value = F.try_element_at(e["attributes"], F.lit(name))
            short = F.when(F.length(value) > 60, F.concat(F.substring(value, 1, 57), F.lit("..."))).otherwise(value)
            parts.append(F.concat(F.lit(f'{name}="'), short, F.lit('"')))
        attrs = F.array_join(F.array_compact(F.array(*parts)), " ")
        opening = F.concat(F.lit("["), e["index"], F.lit("]<"), e["tag"],
                           F.when(attrs != "", F.concat(F.lit(" "), attrs)).otherwise(F.lit("")))
        full = F.concat(opening, F.lit(">"), e["text"], F.lit("</"), e["tag"], F.lit(">"))
        return F.when(e["tag"].isin(VOID_TAGS) | (e["text"] == ""), F.concat(opening, F.lit("/>"))).otherwise(full)

    rows = _with_elements(pages, limit, max_text)
    return rows.select("page_id", F.array_join(F.transform("elements", line), "\n").alias("text"),
                       F.size("elements").alias("element_count"))
