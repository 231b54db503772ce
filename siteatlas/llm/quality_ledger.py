"""Quality rules as a ledger: every rule is evaluated once and leaves a bit; policies are masks over the bits.

The ledger keeps the failure bits and the measurements behind them.  A policy names the rules that reject a document; it
is applied, compared with other versions and taken apart (ablation) by bit operations on the stored ledger, without a look
at the texts.  All expressions are built-in functions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import whole_row

_BLANK = "[ \\t\\n\\x0B\\f\\r]"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

# Measurements, in the order of the ledger's struct.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper")

# Rule -> SQL condition over the measurements that means failure.  The position is the rule's bit; new rules go last.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > word_chars",
    "few_words_in_line": "n_lines > 3 and n_words < 2 * n_lines",
}


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document goes if it fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "many_symbols", "short_mean_word", "long_mean_word"))
# Repeated lines alone are left to line dedup: documents that are sound without them stay.
V2 = Policy("v2", (*V1.rules, "shouting"))
POLICIES = (BASE, V1, V2)
CURRENT = V2


def _without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def _windows(words: Column, size: int) -> Column:
    """A hash for each window of ``size`` words; none for shorter texts."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(F.struct(hashes.alias("h"), starts.alias("s"))), lambda x: F.transform(
        x["s"], lambda i: F.xxhash64(*[F.get(x["h"], i + k) for k in range(size)])))[0]


def _covered(grams: Column, size: int) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep neighbours that agree, add up the gaps."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twins(p: Column) -> Column:
        same = F.filter(p, lambda x, k: (F.get(p, k - 1)["g"] == x["g"]) | (F.get(p, k + 1)["g"] == x["g"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    places = F.transform(F.array(placed), twins)[0]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(places, start, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")))["n"]


def measured(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``row`` (all columns of ``docs`` in a struct) and ``m``, the struct of ``MEASURES``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(whole_row(docs), text.alias("text"),
                       F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "").alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "").alias("lines"))
    base = base.withColumn("grams", _windows(F.col("words"), window))
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    letters = _without(F.col("text"), _BLANKS)
    n_chars = F.length("text")
    values = {
        "n_words": F.size("words"), "word_chars": F.length(letters),
        "n_symbols": n_chars - F.length(_without(F.col("text"), _SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(repeated, _covered(F.col("grams"), window)).otherwise(F.lit(0)),
        "n_chars": n_chars, "n_lines": F.size("lines"),
        "n_upper": n_chars - F.length(F.regexp_replace("text", "[A-Z]+", "")),
    }
    return base.select("row", F.struct(*[values[m].cast("long").alias(m) for m in MEASURES]).alias("m"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, ``m`` and ``failed``: bit i is set if rule i of ``RULES`` fails.

    Null text counts as empty: no words, lines or symbols; it fails ``few_words``.  Ratios are compared by products, so
    nothing is divided by zero.  Repeated rows: a ledger row each.  Empty table: no rows.  Other columns, whatever their
    names, stay in ``row``.  Very long texts: all steps are linear but one sort of a text's windows.
    """
    m = measured(docs, text_col)
    bits = [F.when(_over_measures(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return m.withColumn("failed", failed.cast("long"))


def _over_measures(condition: str) -> Column:
    for name in MEASURES:
        condition = _replace_name(condition, name)
    return F.expr(condition)


def _replace_name(condition: str, name: str) -> str:
    return " ".join(f"m.{name}" if part == name else part for part in condition.split(" "))


def passes(policy: Policy, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def keep(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that pass ``policy``, with their own columns."""
    rows = ledger(docs).where(passes(policy))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy, from the stored bits: documents it fails, fails alone, and those kept without it.

    One pass: the distinct bit patterns are counted (at most 2^rules of them), the rest is arithmetic on the counts.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    columns = []
    for rule in policy.rules:
        bit = 1 << list(RULES).index(rule)
        hit = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        alone = F.col("failed").bitwiseAND(F.lit(policy.mask)) == bit
        without = F.col("failed").bitwiseAND(F.lit(policy.mask & ~bit)) == 0
        columns.append(F.struct(F.lit(rule).alias("rule"), *[
            F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a)
            for c, a in ((hit, "n_failed"), (alone, "n_failed_alone"), (without, "n_kept_without"))]))
    one = patterns.agg(F.array(*columns).alias("r"))
    return one.select(F.explode("r").alias("r")).select(F.lit(policy.version).alias("version"), "r.*")


def digest(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return rows.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"m.{x}").alias(x) for x in MEASURES[:5]],
                       (~passes(BASE)).alias("base_failed"), passes(policy).alias("kept"), F.col("failed").alias("failed_bits"))
