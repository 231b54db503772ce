"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import dealt
from siteatlas.session import cut_lineage, forget

def _smallest(edges: DataFrame) -> DataFrame:
    """``a, b, m`` for every edge (a, b): m is the smallest of a and its neighbours b.

    The minimum is combined before the shuffle.  It is written out, so that both sides of the join are plain exchanges,
    of which AQE splits a hub's edges over tasks.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = cut_lineage(least, "components-least")
    return edges.join(dealt(least), "a").select("a", "b", "m")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge to another one; the root is the smallest node of its component.

    First every node that has a smaller neighbour is hung on its smallest one; what is left to find out is which of those
    belong together, a much smaller graph where edges lead to hubs.  Its rounds go on until the edges stay as they are,
    O(log^2 n) at most; each is written to the shared folder, so a lost executor costs one round.  Loops and edges with a
    null end are ignored; repeated edges count once.
    """
    given = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b and a is not null and b is not null")
    given = cut_lineage(given.distinct(), "components-given")
    n = given.count()
    given = dealt(given, n)
    hung = dealt(cut_lineage(given.groupBy("a").agg(F.min("b").alias("m")), "components-hung"), n)
    across = given.join(hung, "a").where("b <> m").select(F.greatest("m", "b").alias("a"), F.least("m", "b").alias("b"))
    upward = hung.join(given.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.col("m").alias("b"))
    roots = _stars(across.unionAll(upward))
    hubs = given.select(F.col("b").alias("a"), F.col("b").alias("m")).distinct().join(hung.select("a"), "a", "left_anti")
    every = hung.unionAll(hubs).join(roots.withColumnRenamed("node", "m"), "m", "left")
    return every.select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))


def _stars(edges: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of an edge table (a, b) with a > b, by alternating large and small stars."""
    now = written = cut_lineage(edges.distinct(), "components")
    mark = _fingerprint(now)
    while mark[0]:
        # A graph of a few edges takes one task and no shuffle a round; the number of tasks follows its size.
        now = dealt(now, 2 * mark[0])
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, "components")
        small = _smallest(dealt(large))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            small.select("a", F.col("m").alias("b"))).distinct()
        written, old = cut_lineage(small, "components"), written
        now = written
        forget(old)
        forget(large)
        last, mark = mark, _fingerprint(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
