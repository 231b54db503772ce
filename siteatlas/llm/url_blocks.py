"""URL rules, and block decisions that follow redirects and canonical links.

A URL that a rule fits has that rule's verdict.  Every other URL has the verdict of its alias group, the connected
component over redirect and canonical-link edges: allow if a rule allows a member, else block if a rule blocks one, else
allow.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions.html import decode_entities
from siteatlas.functions.urls import _no_dots
from siteatlas.llm.components import components
from siteatlas.session import cut_lineage

# (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(url: Column) -> Column:
    """``{host, path, query}``; bound once, so that uses of it don't repeat the patterns."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    return F.transform(F.array(rest), lambda x: F.struct(
        F.translate(F.regexp_extract(x, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(x, r"(?s)\A[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(x, r"(?s)\A[^?#]*(\?[^#]*)", 1).alias("query")))[0]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(_parts(url)["host"], F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(_parts(url)["path"], F.lit(""))


def address(url: Column) -> Column:
    """What names a page: host, path and query without the scheme and fragment; null where there is no host.

    ``.`` and ``..`` in the path are resolved, and an empty path is ``/``.
    """
    return F.transform(F.array(_parts(url)), lambda p: F.when(
        p["host"] != "", F.concat(p["host"], F.when(p["path"] == "", "/").otherwise(_no_dots(p["path"])), p["query"])))[0]


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``{length, allow, rule, verdict}``; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of one rule with two verdicts, allow wins.
    """
    return F.transform(F.array(F.struct(host.alias("host"), path.alias("path"))),
                       lambda u: _longest(u["host"], u["path"], rules))[0]


def _longest(host: Column, path: Column, rules) -> Column:
    found = []
    for rule, verdict in rules:
        at = rule.index("/") if "/" in rule else len(rule)
        rule_host, rule_path = rule[:at].translate(str.maketrans(_UPPER, _LOWER)), rule[at:]
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(int(verdict == "allow")).alias("allow"),
                                           F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<length:int,allow:int,rule:string,verdict:string>")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(decode_entities(F.regexp_replace(value, r"""\A["']|["']\z""", "")))


def _absolute(target: Column, url: Column) -> Column:
    """A link's target against the page's URL."""
    scheme = F.regexp_extract(url, r"(?s)\A(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*\z", "")
    return (F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
            .when(target.startswith("?"), F.concat(site, path_of(url), target))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target)))


def page_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: addresses of a page and of the pages that its canonical link or its refresh names.

    Pages without such a tag are left out by a plain substring test before any pattern runs.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    maybe = pages.select(pages["url"].alias("url"), html.alias("html")).where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = maybe.select("url", F.explode(tags).alias("tag"))
    refresh = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)\A[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    target = (F.when(F.col("tag").rlike(r"(?i)\A<link") & F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical($|\s)"),
                     _attribute(F.col("tag"), "href"))
              .when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.trim(refresh)))
    # Few pages have such tags: written out, the links are resolved in a plan of their own.
    found = cut_lineage(tag.select("url", target.alias("target")).where("target is not null"), "page-links")
    return found.select(address(F.col("url")).alias("a"), address(_absolute(F.col("target"), F.col("url"))).alias("b"))


def judge(urls: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, alias_verdict`` of every row; ``edges`` holds addresses ``a, b``.

    ``alias_verdict`` is what the row's alias group says, null outside of groups or where no rule fits a member.  Null
    urls and urls without ``://``: empty host and path, no rule, the default verdict.  Repeated rows: judged each; null
    ids stay null.  Edges that repeat, loop or have a null end change nothing; empty tables give no rows or no groups.
    Members of a group need not be among the rows.  Other columns are left alone.
    """
    url = urls[url_col]
    own = urls.select(urls[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    own = own.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    # Ends that callers name in other ways, without the slash of an empty path say, are the same pages.
    groups = components(edges.select(*[address(F.concat(F.lit("x://"), F.col(x))).alias(x) for x in ("a", "b")]))
    url_of = F.concat(F.lit("x://"), F.col("node"))
    judged = groups.select("node", "root", rule_for(host_of(url_of), path_of(url_of), rules)["verdict"].alias("v"))
    per_root = judged.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allows"), F.max(F.col("v") == "block").alias("blocks"))
    said = per_root.select("root", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("alias_verdict"))
    aliases = groups.join(said, "root").where("alias_verdict is not null").select(F.col("node").alias("address"), "alias_verdict")
    # Only urls without a rule ask their group; a null key, which many rows may share, finds no partner.
    asked = own.withColumn("ask", F.when(F.col("fit").isNull(), F.col("address"))).join(
        aliases.withColumnRenamed("address", "ask"), "ask", "left")
    return asked.select("id", "host", "path", F.col("fit.rule").alias("rule"),
                        F.coalesce("fit.verdict", "alias_verdict", F.lit(DEFAULT)).alias("verdict"), "alias_verdict")


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    return judge(pages, page_edges(pages), rules)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
