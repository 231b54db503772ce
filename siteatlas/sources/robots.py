"""robots.txt bodies, one row per host, as rule arrays.

A body is parsed inside its row: it is cut at the agent lines, the blocks of
the wanted agent are kept, and their lines read.  Nothing is grouped or
collected, so rules are never larger than the file they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.functions.bind import let


def directives(body: Column, agent: str = "*") -> Column:
    """array<struct<key, value, line>> of the blocks that hold for ``agent``.

    Of consecutive agent lines only the last decides, and lines before the
    first agent line hold for nobody: a block starts at each agent line.
    """
    blocks = F.split(body, r"(?im)^[ \t]*user-agent[ \t]*:")
    numbered = F.transform(blocks, lambda b, i: F.struct(
        F.lower(X.trimmed(F.substring_index(b, "\n", 1))).alias("agent"), b.alias("text"), i.alias("block")))
    wanted = F.filter(numbered, lambda b: (b["block"] > 0) & b["agent"].isin("*", agent.lower()))
    lines = F.flatten(F.transform(wanted, lambda b: F.transform(
        F.split(b["text"], "\n"), lambda line, i: F.struct(
            F.lower(X.trimmed(F.regexp_extract(line, r"^([^:]*):", 1))).alias("key"),
            X.trimmed(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"),
            X.trimmed(line).alias("raw"), i.alias("i")))))
    told = F.filter(lines, lambda d: (d["i"] > 0) & ~F.startswith(d["raw"], F.lit("#")) & (d["key"] != ""))
    return F.transform(told, lambda d, i: F.struct(d["key"].alias("key"), d["value"].alias("value"), i.alias("line")))


def robots_rules(bodies: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules, crawl_delay_ms, sitemaps) from (host, body).

    ``rules`` is sorted by path length, later lines last among equals, so the
    last matching rule is the one that counts.
    """
    found = bodies.select("host", directives(F.col("body"), agent).alias("d"))

    def values(key: str) -> Column:
        return F.transform(F.filter("d", lambda d: d["key"] == key), lambda d: d["value"])

    rules = F.array_sort(F.transform(
        F.filter("d", lambda d: d["key"].isin("allow", "disallow") & (d["value"] != "")),
        lambda d: F.struct(F.length(d["value"]).alias("length"), d["line"].alias("line"), d["value"].alias("path"),
                           (d["key"] == "allow").alias("allow"))))
    numbers = F.filter(F.transform(values("crawl-delay"), lambda v: F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)", 1)),
                       lambda v: v != "")
    delay = let(numbers, lambda all_of: F.try_element_at(all_of, F.lit(-1))).cast("double") * 1000
    return found.select("host", rules.alias("rules"), delay.alias("crawl_delay_ms"), values("sitemap").alias("sitemaps"))


def rule_index(rules: DataFrame) -> DataFrame:
    """(host, prefix, size, allow): one row per rule path of a host, the later line counting among equals.

    A path of a host is then decided by its longest prefix in this table.
    """
    every = rules.select("host", F.inline("rules"))
    return every.groupBy("host", F.col("path").alias("prefix")).agg(
        F.first("length").alias("size"), F.max_by("allow", "line").alias("allow"))


def mark_allowed(requests: DataFrame, rules: DataFrame, name: str = "robots_allowed") -> DataFrame:
    """Add whether robots.txt of the URL's host allows each request: the longest matching rule decides, no rule allows.

    Every distinct path of a host is cut to the few lengths that rules of that
    host have, and looked up by equality, so the work follows the requests and
    not requests times rules.  Lengths are as many as there are distinct ones,
    never the rules themselves; a host with many URLs is split by AQE.
    """
    hosted = requests.withColumns({"_host": U.hostname(F.col("url")), "_path": U.path(F.col("url"))})
    index = rule_index(rules)
    sizes = index.groupBy(F.col("host").alias("_host")).agg(F.collect_set("size").alias("_sizes"))
    paths = hosted.select("_host", "_path").distinct().join(sizes, "_host")
    probes = paths.select("_host", "_path", F.explode(F.filter("_sizes", lambda n: n <= F.length("_path"))).alias("size"))
    probes = probes.withColumn("prefix", F.substring("_path", F.lit(1), F.col("size")))
    hits = probes.join(index.select(F.col("host").alias("_host"), "prefix", "allow"), ["_host", "prefix"])
    told = hits.groupBy("_host", "_path").agg(F.max_by("allow", "size").alias("_allow"))
    joined = hosted.join(told, ["_host", "_path"], "left")
    return joined.select(*requests.columns, F.coalesce("_allow", F.lit(True)).alias(name))


def crawl_delay(rules: DataFrame, configured_ms: int) -> DataFrame:
    """(host, delay_ms): the larger of the configured and the asked delay."""
    return rules.select("host", F.greatest(F.lit(float(configured_ms)), F.coalesce("crawl_delay_ms", F.lit(0.0))).alias("delay_ms"))
