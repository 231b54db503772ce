"""Order-dependent steps that do not put a whole key into one task.

A window per key sorts all rows of that key in one task, which a key holding a
third of the data does not survive.  These steps cut each key's sequence into
order-aligned chunks, work per (key, chunk), and carry a small summary from
chunk to chunk.  ``chunk`` columns must be non-decreasing along ``order``; the
usual one is ``chunk_of(seq)``, which bounds a chunk by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000
SALTS = 64


def chunk_of(seq: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique sequence number: at most ``rows`` rows each."""
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / F.lit(rows)).cast("bigint")


def _with_chunks(df: DataFrame, chunk: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_chunk{i}" for i in range(len(chunk))]
    return df.withColumns(dict(zip(names, chunk))), names


def running_totals(df: DataFrame, keys: list[str], chunk: list[Column], order: list[str],
                   totals: dict[str, Column]) -> DataFrame:
    """Add running sums (current row included) per key along ``order``."""
    rows, parts = _with_chunks(df, chunk)
    rows = rows.withColumns({f"_v_{n}": v for n, v in totals.items()})
    sums = rows.groupBy(*keys, *parts).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*parts).rowsBetween(
        Window.unboundedPreceding, -1)
    before = sums.select(*keys, *parts, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
                                          for n in totals])
    inside = Window.partitionBy(*keys, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in totals})
    joined = local.join(before, [*keys, *parts])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in totals])


def running_streak(df: DataFrame, keys: list[str], chunk: list[Column], order: list[str],
                   hit: Column, reset: Column, name: str) -> DataFrame:
    """Add the number of hits since the last reset per key along ``order``."""
    rows, parts = _with_chunks(df, chunk)
    rows = rows.withColumns({"_hit": hit.cast("bigint"), "_reset": reset})
    inside = Window.partitionBy(*keys, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_run", F.sum("_hit").over(inside))
    local = local.withColumn("_level", F.max(F.when(F.col("_reset"), F.col("_run"))).over(inside))
    chunks = local.groupBy(*keys, *parts).agg(F.max("_run").alias("_hits"), F.max("_level").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_hits").over(earlier), F.lit(0)))
    chunks = chunks.withColumn("_floor", F.coalesce(F.max(F.col("_before") + F.col("_last")).over(earlier), F.lit(0)))
    carry = chunks.select(*keys, *parts, (F.col("_before") - F.col("_floor")).alias("_carry"))
    joined = local.join(carry, [*keys, *parts])
    streak = F.when(F.col("_level").isNull(), F.col("_carry") + F.col("_run")).otherwise(F.col("_run") - F.col("_level"))
    return joined.select(*df.columns, streak.alias(name))


def previous_row(df: DataFrame, keys: list[str], chunk: list[Column], order: list[str],
                 columns: list[str], name: str) -> DataFrame:
    """Add a struct of ``columns`` of the previous row per key along ``order``."""
    rows, parts = _with_chunks(df, chunk)
    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    local = rows.withColumn("_prev", F.lag(F.struct(*columns)).over(inside))
    last = rows.groupBy(*keys, *parts).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    carry = last.select(*keys, *parts, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(*parts)).alias("_carry"))
    joined = local.join(carry, [*keys, *parts])
    return joined.select(*df.columns, F.coalesce("_prev", "_carry").alias(name))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Spark turns a row_number bound into a group limit before the shuffle, so
    each task sends at most ``n`` rows of a key; it does so up to a threshold.
    Above it, the cut is made per key and salt first, so that no task sorts
    more than its share of a key and the last one sees ``SALTS * n`` rows.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit >= 0:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("rank", part).where(F.col("rank") <= n).drop("rank", "_salt")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def mark_first_n(df: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """Add whether a row is among the first ``n`` of its key; NULL keys always are.

    Rows without a key are spread by a salt: in a join they would all meet in
    one task.
    """
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    cut = first_n(df.where(has_key).select(*keys, *order), keys, order, n).groupBy(*keys).agg(
        F.max(F.struct(*order)).alias("_cut"))
    salt = F.when(has_key, F.lit(0)).otherwise(F.pmod(F.xxhash64(*order), F.lit(4096)).cast("int"))
    joined = df.withColumn("_salt", salt).join(cut.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left")
    return joined.select(*df.columns, F.coalesce(F.struct(*order) <= F.col("_cut"), F.lit(True)).alias(name))
