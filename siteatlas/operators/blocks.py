"""Failure streaks, challenge counts and throttling per domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.operators import ordered


def _slow_down(streak: Column, threshold: int, most: int = 16) -> Column:
    """Doubles with each signal of a streak; 1 below the threshold."""
    return F.when(streak >= threshold, F.least(F.lit(float(most)), F.pow(F.lit(2.0), streak - threshold + 1))).otherwise(
        F.lit(1.0))


def failure_streaks(events: DataFrame, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Add ``streak``: failures of the domain since its last success."""
    return ordered.running_streak(events, ["domain"], [ordered.chunk_of("seq", rows)], ["seq"],
                                  F.col("kind") == "failure", F.col("kind") == "success", "streak")


def _limited() -> Column:
    return F.contains("error_message", F.lit("429")) | F.contains(F.lower("error_message"), F.lit("rate limit"))


def signals(events: DataFrame, threshold: int = 5) -> DataFrame:
    """Add multiplier, reason and action to events with their streak and challenges."""
    failing = (F.col("kind") == "failure") & (F.col("streak") >= threshold)
    flood = (F.col("kind") == "challenge") & (F.col("challenges") >= threshold)
    limited = F.coalesce(_limited(), F.lit(False))
    return events.withColumns({
        "multiplier": _slow_down(F.col("streak"), threshold),
        "reason": F.when(failing & limited, "rate-limited").when(failing, "consecutive-failures").when(flood, "challenge-flood"),
        "recommended_action": F.when(failing & limited, "back-off").when(failing | flood, "rotate-proxy")})


def failure_signals(events: DataFrame, threshold: int = 5, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """One row per failure that reaches the threshold, with reason and action."""
    limited = _limited()
    found = failure_streaks(events, rows).where((F.col("kind") == "failure") & (F.col("streak") >= threshold))
    return found.select("seq", "domain", F.col("streak").alias("consecutive_count"),
                        F.when(limited, "rate-limited").otherwise("consecutive-failures").alias("reason"),
                        F.when(limited, "back-off").otherwise("rotate-proxy").alias("recommended_action"))


def challenge_counts(events: DataFrame, threshold: int = 5, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Running challenge count per domain (never reset) and its signal."""
    seen = events.where(F.col("kind") == "challenge").select("seq", "domain")
    counted = ordered.running_totals(seen, ["domain"], [ordered.chunk_of("seq", rows)], ["seq"],
                                     {"challenges": F.lit(1).cast("bigint")})
    return counted.withColumn("reason", F.when(F.col("challenges") >= threshold, "challenge-flood"))


def delay_multipliers(events: DataFrame, threshold: int = 5, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Add the delay multiplier in force after each event of a domain."""
    return failure_streaks(events, rows).withColumn("multiplier", _slow_down(F.col("streak"), threshold))


def domain_health(events: DataFrame, threshold: int = 5) -> DataFrame:
    """Per domain: trailing failures, challenges, multiplier, blocked.

    Only the trailing streak is needed, so no window: failures after the last
    success are counted with two aggregates, both combined before the shuffle.
    """
    last = events.groupBy("domain").agg(
        F.max(F.when(F.col("kind") == "success", F.col("seq"))).alias("last_success"),
        F.count_if(F.col("kind") == "challenge").alias("challenges"))
    failures = events.where(F.col("kind") == "failure").select(F.col("domain"), "seq")
    after = (failures.join(last.select("domain", "last_success"), "domain")
             .where(F.col("last_success").isNull() | (F.col("seq") > F.col("last_success")))
             .groupBy("domain").agg(F.count(F.lit(1)).alias("failures")))
    joined = last.join(after, "domain", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return joined.select(
        "domain", "failures", "challenges", _slow_down(F.col("failures"), threshold).alias("multiplier"),
        ((F.col("failures") >= threshold) | (F.col("challenges") >= threshold)).alias("blocked"))


def within_error_budget(events: DataFrame, budget: int = 20, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Events a session handles before its ``budget``-th failure stops it."""
    counted = ordered.running_totals(events, ["session_id"], [ordered.chunk_of("seq", rows)], ["seq"],
                                     {"_errors": (F.col("kind") == "failure").cast("bigint")})
    before = F.col("_errors") - (F.col("kind") == "failure").cast("bigint")
    return counted.where(before < budget).drop("_errors")
