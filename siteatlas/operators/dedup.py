"""URL and page deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.operators import neardup, ordered
from siteatlas.operators.structure import staged
from siteatlas.session import cut_lineage


def first_per_url(requests: DataFrame, order: list[str]) -> DataFrame:
    """First request per normalized URL, with ``normalized`` added."""
    named = requests.withColumn("normalized", U.normalize(F.col("url")))
    first = named.groupBy("normalized").agg(F.min_by(F.struct(*requests.columns), F.struct(*order)).alias("_first"))
    return first.select("normalized", "_first.*")


def admission(requests: DataFrame, order: list[str]) -> DataFrame:
    """Add ``added``: whether a request was the first of its URL."""
    named = requests.withColumn("normalized", U.normalize(F.col("url")))
    return ordered.mark_first_n(named, ["normalized"], order, 1, "added")


def seen(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests whose URL is known under its normalized form."""
    keys = known.select(U.normalize(F.col("url")).alias("_known")).distinct()
    return requests.withColumn("_n", U.normalize(F.col("url"))).join(keys, F.col("_n") == F.col("_known"), "left_semi").drop("_n")


def unseen(requests: DataFrame, known: DataFrame) -> DataFrame:
    keys = known.select(U.normalize(F.col("url")).alias("_known")).distinct()
    return requests.withColumn("_n", U.normalize(F.col("url"))).join(keys, F.col("_n") == F.col("_known"), "left_anti").drop("_n")


def canonical_duplicates(pages: DataFrame) -> DataFrame:
    """Pages whose canonical URL was visited earlier: (seq, url, canonical, original_seq).

    Needs seq, url, canonical.
    """
    own = pages.select("seq", "url", "canonical", U.normalize(F.col("url")).alias("_own"),
                       U.normalize(F.col("canonical")).alias("_target")).where(F.col("canonical").isNotNull())
    visited = pages.groupBy(U.normalize(F.col("url")).alias("_visited")).agg(F.min("seq").alias("original_seq"))
    found = own.where(F.col("_own") != F.col("_target")).join(visited, F.col("_target") == F.col("_visited"))
    return found.where(F.col("original_seq") < F.col("seq")).select("seq", "url", "canonical", "original_seq")


def without_alternates(candidates: DataFrame, alternates: DataFrame) -> DataFrame:
    """Candidates that are not an alternate language of a crawled page."""
    return unseen(candidates, alternates)


def fingerprints(pages: DataFrame) -> DataFrame:
    """(seq, url, title, links, forms, length) of captured pages."""
    bare = F.col("bare")
    raw = staged(pages).withColumn("raw_links", H.raw_links(bare))
    return raw.select(
        F.col("page_id").alias("seq"), "url", H.title(bare).alias("title"),
        F.size(H.links_from(F.col("raw_links"), F.col("url"))).alias("links"),
        F.size(H.open_tags(bare, "form")).alias("forms"), F.length("html").alias("length"))


def exact_duplicates(prints: DataFrame) -> DataFrame:
    """Pages whose structure (title, link and form count) was seen earlier."""
    marked = ordered.mark_first_n(
        prints.withColumn("structure", X.structure_hash(F.col("links"), F.col("forms"), F.col("title"))),
        ["structure"], ["seq"], 1, "first")
    return marked.where(~F.col("first")).drop("first")


# ---- near duplicates ----------------------------------------------------------
#
# The score is 0.4 for equal titles, 0.3 for link and form counts (1 - d/20 for a
# distance d up to 20) and 0.3 for the ratio of lengths.  For a threshold above
# 0.7 only pages of one title can match, and their distance d is bounded, so a
# page meets others only in classes (title, links, forms) close to its own.  A
# class keeps at most one page: a second one would have a seen structure.  The
# kept set is therefore as small as the class table, and each page is compared
# with the kept pages of the few classes around it, never with a whole group.

CLASS = ["title", "links", "forms"]


def max_distance(threshold: float) -> int:
    """Largest link plus form distance two similar pages can have."""
    if not 0.7 < threshold <= 1.0:
        raise ValueError("near-duplicate search needs a threshold in (0.7, 1]")
    return int((1.0 - threshold) / 0.015 + 1e-9)


def _score(k: Column) -> Column:
    """Score of the row's page against a page ``k`` of the same title."""
    a = {"title": F.lit(0), "links": F.col("links"), "forms": F.col("forms"), "length": F.col("length")}
    b = {"title": F.lit(0), "links": k["links"], "forms": k["forms"], "length": k["length"]}
    return X.fingerprint_similarity(a, b)


def _class_neighbours(classes: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """(class a, other class b) of one title within ``reach``: at most 9 grid cells each.

    Pairs of classes, not of pages; a class has a bounded number of them.
    """
    step = reach + 1

    def cell(col: str) -> Column:
        return F.floor(F.col(col) / step).cast("bigint")

    around = F.expr("transform(sequence(0, 8), i -> struct(i div 3 - 1 AS dl, i % 3 - 1 AS df))")
    a = (classes.select("title", F.col("links").alias("a_links"), F.col("forms").alias("a_forms"), cell("links").alias("_l"),
                        cell("forms").alias("_f"), F.explode(around).alias("d"))
         .select("title", "a_links", "a_forms", (F.col("_l") + F.col("d.dl")).alias("_l"), (F.col("_f") + F.col("d.df")).alias("_f")))
    b = others.select("title", F.col("links").alias("b_links"), F.col("forms").alias("b_forms"), cell("links").alias("_l"),
                       cell("forms").alias("_f"))
    apart = F.abs(F.col("a_links") - F.col("b_links")) + F.abs(F.col("a_forms") - F.col("b_forms"))
    return a.join(b, ["title", "_l", "_f"]).where((apart <= reach) & (apart > 0)).drop("_l", "_f")


def near_duplicates(prints: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Decide every page: kept, or a duplicate of an earlier kept page.

    Eager: it runs its rounds when called.

    The rule is sequential: a page is dropped if its structure was kept before
    or an earlier kept page scores at least ``threshold``.  ``neardup.settle``
    finds the kept pages of all titles in few rounds, however long the chains
    of pages are that depend on each other.  ``seq`` numbers the pages; a null
    title is a title of its own.  Returns prints plus kept, reason ('structure'
    or 'similar'), similar_to (first kept page that covers it) and score.
    """
    reach = max_distance(threshold)
    prints = cut_lineage(prints, "near-prints")
    named = prints.withColumn("title", F.coalesce("title", F.lit("")))
    # Identical fingerprints share the fate of their first page, except that the
    # first may be kept; they are joined back at the end.
    points = named.groupBy(*CLASS, "length").agg(F.min("seq").alias("seq"))
    kept, _ = neardup.settle(points, threshold, reach)
    near = _class_neighbours(points.select(*CLASS).distinct(), kept.select(*CLASS).distinct(), reach)
    return _explained(prints, near, kept, threshold)


def _cover(near: DataFrame, kept: DataFrame) -> DataFrame:
    """Per class: kept pages of the class and of the classes around it (bounded)."""
    item = F.struct("seq", "links", "forms", "length").alias("k")
    around = near.join(kept.withColumnsRenamed({"links": "b_links", "forms": "b_forms"}), ["title", "b_links", "b_forms"]).select(
        "title", F.col("a_links").alias("links"), F.col("a_forms").alias("forms"),
        F.struct("seq", F.col("b_links").alias("links"), F.col("b_forms").alias("forms"), "length").alias("k"))
    own = kept.select(*CLASS, item)
    return own.unionByName(around).groupBy(*CLASS).agg(F.collect_list("k").alias("cover"))


def _explained(prints: DataFrame, near: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """Attach to every page the kept page that decides it."""
    cover = _cover(near, kept).withColumnsRenamed({c: f"_{c}" for c in CLASS})
    same_class = (F.coalesce(prints["title"], F.lit("")) == F.col("_title")) & (prints["links"] == F.col("_links")) & (prints["forms"] == F.col("_forms"))
    joined = prints.join(cover, same_class, "left")
    earlier = F.filter("cover", lambda k: k["seq"] < F.col("seq"))
    same = F.exists(earlier, lambda k: (k["links"] == F.col("links")) & (k["forms"] == F.col("forms")))
    similar = F.array_min(F.transform(F.filter(earlier, lambda k: _score(k) >= threshold), lambda k: F.struct(
        k["seq"].alias("seq"), _score(k).alias("score"))))
    is_kept = F.exists("cover", lambda k: k["seq"] == F.col("seq"))
    return joined.select(
        *prints.columns, F.coalesce(is_kept, F.lit(False)).alias("kept"),
        F.when(~is_kept, F.when(same, "structure").otherwise("similar")).alias("reason"),
        F.when(~is_kept & ~same, similar["seq"]).alias("similar_to"),
        F.when(~is_kept & ~same, similar["score"]).alias("score"))


def diminishing_returns(prints: DataFrame, recent: int = 10, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Mean pairwise similarity of the last ``recent`` pages of each site.

    Pages are numbered per site, cut into chunks by number, and the last pages
    of a chunk are lent to the next one, so windows never span a whole site.
    """
    sited = prints.withColumn("site", U.hostname(F.col("url")))
    numbered = ordered.running_totals(sited, ["site"], [ordered.chunk_of("seq", chunk_rows)], ["seq"],
                                      {"position": F.lit(1).cast("bigint")})
    size = max(chunk_rows, recent)
    home = F.floor((F.col("position") - 1) / size)
    lent = F.when((F.col("position") - 1) % size >= size - recent + 1, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(lent))
    window = Window.partitionBy("site", "_chunk").orderBy("position").rowsBetween(1 - recent, 0)
    last = F.collect_list(F.struct("title", "links", "forms", "length")).over(window)
    rows = spread.withColumn("_last", last).where(F.col("_chunk") == F.col("_home"))
    scores = F.flatten(F.transform("_last", lambda a, i: F.transform(
        F.slice("_last", i + 2, F.lit(recent)), lambda b: X.fingerprint_similarity(a, b))))
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s) / F.lit(recent * (recent - 1) / 2)
    return rows.where(F.col("position") >= recent).select(
        "seq", "site", "position", mean.alias("mean_similarity"), (mean > 0.8).alias("diminishing"))
