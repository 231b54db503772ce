"""Divergence of the sources of a language, on run-length columns.

Each language keeps the terms that enough of its documents hold.  A (language, source) group gives every kept term a smoothed share p
in billionths, and two groups differ by the sum of abs(p - q) over the kept terms.  With one column of counts a group, the vocabulary
is put into an order in which equal counts are neighbours, every column is stored as runs of equal counts, and a pair of columns is
compared run by run: their boundaries are merged, and between two boundaries abs(p - q) counts as often as the stretch is long.

Counting is one pass: a task counts the terms of its own documents, and the rows (language, source, term) are summed.  The kept
vocabulary is cut into chunks of bounded size along its order, so no task holds a language; a chunk gives partial sums of all pairs of
its language's sources, which is as many rows as the result has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.terms import LETTERS, TermBatch, counted
from siteatlas.session import cut_lineage

LEAST_DOCS, TOP_TERMS, SMOOTH, BILLION = 30, 50, 5, 1_000_000_000
# Rows that a task combines before it sends them; kept terms and entries of a chunk of run-length columns.
COMBINED, CHUNK_TERMS, CHUNK_ENTRIES = 1_000_000, 4096, 1_000_000
# Sources, from the largest on, whose counts lead the order of the vocabulary.
LEADING = 4


# ---- counts

def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    found = TermBatch(batch.column(2), LETTERS)
    doc, number, count = counted(np.repeat(np.arange(batch.num_rows), found.sizes()), found.number, len(found.spelled))
    lang, source = (batch.column(c).dictionary_encode() for c in (0, 1))
    wide = max(len(source.dictionary), 1)
    group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
    key = group[doc] * max(len(found.spelled), 1) + number
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    key = key[begin]
    total = np.add.reduceat(count[order], begin) if len(key) else count
    docs = np.diff(np.append(begin, len(order)))
    group, number = key // max(len(found.spelled), 1), key % max(len(found.spelled), 1)
    return pa.table({
        "lang": lang.dictionary.take(pa.array(group // wide)).cast(pa.string()),
        "source": source.dictionary.take(pa.array(group % wide)).cast(pa.string()),
        "term": found.spelled.take(pa.array(number)).cast(pa.string()), "n": pa.array(total, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def combined() -> Iterator[pa.RecordBatch]:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        sums = sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])
        return iter(sums.combine_chunks().to_batches(max_chunksize=100_000))

    for batch in batches:
        held.append(_batch_counts(batch))
        if sum(t.num_rows for t in held) >= COMBINED:
            yield from combined()
            held = []
    if held:
        yield from combined()


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n, total, leads``: the counts above 0 of the kept terms, the language's count, and whether the row is
    the first of its term in the language.  ``docs`` has lang, source and text without nulls.

    Rows move once, by language and term; what follows is local to that partitioning.
    """
    sums = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    whole = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (whole.withColumns({"_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "_least": F.min("source").over(term)})
            .where(F.col("_docs") >= least_docs)
            .select("lang", "source", "term", "n", "total", (F.col("source") == F.col("_least")).alias("leads")))


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (size + 5 terms)), in decimals, as the product can pass 64 bits."""
    return (F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)"),
                            (size + SMOOTH * terms).cast("decimal(20,0)")) + 1).cast("long")


def group_sizes(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, source, size, number`` of every group, the largest of a language numbered 0, and ``lang, terms, lang_size``."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    every = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("size"), "source")) - 1
    groups = cut_lineage(every.withColumn("number", number), "divergence-groups")
    terms = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size")).join(terms, "lang", "left")
    return groups, cut_lineage(langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "lang_size"), "divergence-langs")


# ---- run-length columns

CHUNKS = "lang string, terms int, numbers array<int>, starts array<array<int>>, counts array<array<long>>"


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, dtype=np.int64)
    return starts, column[starts]


def _encoded(lang: str, place: np.ndarray, number: np.ndarray, n: np.ndarray, terms: int) -> pa.RecordBatch:
    numbers, starts, counts = [], [], []
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        column = np.zeros(terms, dtype=np.int64)
        column[place[part]] = n[part]
        s, c = runs(column)
        numbers.append(int(number[part[0]]))
        starts.append(s.astype(np.int32))
        counts.append(c)
    return pa.RecordBatch.from_arrays([
        pa.array([lang]), pa.array([terms], pa.int32()), pa.array([numbers], pa.list_(pa.int32())),
        pa.array([starts], pa.list_(pa.list_(pa.int32()))), pa.array([counts], pa.list_(pa.list_(pa.int64())))],
        names=["lang", "terms", "numbers", "starts", "counts"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the columns from terms that come in the order of the vocabulary."""
    lang, held, entries, terms = None, [], 0, 0

    def chunk() -> pa.RecordBatch:
        place, number, n = (np.concatenate(x) for x in zip(*held, strict=True))
        return _encoded(lang, place, number, n, terms)

    for batch in batches:
        column = batch.column(1)
        sizes, flat = column.value_lengths().to_numpy(), column.flatten()
        number, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = np.cumsum(sizes)
        for i, name in enumerate(batch.column(0).to_pylist()):
            if terms and (name != lang or terms == CHUNK_TERMS or entries + sizes[i] > CHUNK_ENTRIES):
                yield chunk()
                held, entries, terms = [], 0, 0
            lang = name
            at = slice(ends[i] - sizes[i], ends[i])
            held.append((np.full(sizes[i], terms), number[at], n[at]))
            entries, terms = entries + int(sizes[i]), terms + 1
    if terms:
        yield chunk()


def run_columns(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks of the run-length columns of all groups; a group without a count in a chunk has no column there.

    The order of a language's vocabulary: by the counts of its largest sources, one after another, then by a hash of all counts,
    so terms that count the same everywhere are neighbours.
    """
    entries = kept.join(groups.select("lang", "source", "number"), ["lang", "source"])
    listed = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("counts"))
    by = F.map_from_entries("counts")
    lead = [F.coalesce(F.try_element_at(by, F.lit(i)), F.lit(0)).alias(f"_{i}") for i in range(LEADING)]
    terms = cut_lineage(listed.select("lang", "counts", *lead, F.xxhash64("counts").alias("_h")), "divergence-terms")
    key = ["lang", *[f"_{i}" for i in range(LEADING)], "_h"]
    ordered = terms.repartitionByRange(*key).sortWithinPartitions(*key)
    return cut_lineage(ordered.select("lang", "counts").mapInArrow(_pack, CHUNKS), "divergence-runs")


def _shares(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    if len(counts) and (int(counts.max()) + SMOOTH) * BILLION >= 1 << 63:
        return np.array([1 + BILLION * (c + SMOOTH) // (size + SMOOTH * terms) for c in counts.tolist()], dtype=np.int64)
    return 1 + BILLION * (counts + SMOOTH) // (size + SMOOTH * terms)


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], terms: int) -> int:
    """Sum of the differences of two columns of runs (starts, values): their boundaries merged, each stretch counted once."""
    cuts = np.union1d(a[0], b[0])
    differ = np.abs(a[1][np.searchsorted(a[0], cuts, side="right") - 1] - b[1][np.searchsorted(b[0], cuts, side="right") - 1])
    return int((differ * np.diff(np.append(cuts, terms))).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of every pair of groups from chunks, each with its language's kept terms and group sizes."""
    for batch in batches:
        for row in batch.to_pylist():
            length, sizes = row["terms"], row["sizes"]
            own = {k: (np.array(s, dtype=np.int64), _shares(np.array(c, dtype=np.int64), sizes[k], row["kept"]))
                   for k, s, c in zip(row["numbers"], row["starts"], row["counts"], strict=True)}
            zero = np.zeros(1, dtype=np.int64)
            if length:
                column = [own.get(k) or (zero, _shares(zero, size, row["kept"])) for k, size in enumerate(sizes)]
            for i in range(len(sizes) - 1):
                sums = [apart(column[i], column[j], length) if length else 0 for j in range(i + 1, len(sizes))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"]] * len(sums), pa.string()), pa.array([i] * len(sums), pa.int32()),
                    pa.array(np.arange(i + 1, len(sizes)), pa.int32()), pa.array(sums, pa.int64())], names=["lang", "i", "j", "value"])


def pair_values(chunks: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, i, j, value`` for every two groups i < j of a language, by number.

    An empty chunk of each language makes sure that pairs of languages without kept terms are there, with 0.
    """
    sizes = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "size"))), lambda x: x["size"]).alias("sizes"))
    known = cut_lineage(sizes.join(langs, "lang").select("lang", "sizes", F.col("terms").alias("kept")), "divergence-sizes")
    none = known.select("lang", F.lit(0).alias("terms"), *[F.expr(f"cast(array() as {t})").alias(c) for c, t in (
        ("numbers", "array<int>"), ("starts", "array<array<int>>"), ("counts", "array<array<long>>"))])
    both = chunks.unionByName(none).join(known, "lang")
    return both.mapInArrow(_compare, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


# ---- report

def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distance from the other sources of its language (part ``pair``, all
    ranks) and the terms it uses more than the language does (part ``term``, the first ``top_terms`` ranks).

    Null text, lang and source are empty; an empty text has no terms, its group is there all the same, with a count of 0 for every
    kept term.  Texts of any length are counted whole, repeated rows each.  Equal values: rank by the item's UTF-8 bytes.  A language
    without kept terms has pairs of value 0 and no terms; one with a single source has no pairs.  Empty table: no rows.  Other
    columns are not read.
    """
    given = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut_lineage(kept_counts(given, least_docs), "divergence-kept")
    groups, langs = group_sizes(given, kept)
    values = cut_lineage(pair_values(run_columns(kept, groups), groups, langs), "divergence-pairs")
    both = values.select("lang", F.col("i").alias("number"), F.col("j").alias("other"), "value").unionAll(
        values.select("lang", F.col("j"), F.col("i"), "value"))
    names = groups.select("lang", "number", "source")
    pairs = (both.join(names, ["lang", "number"]).join(
        names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    sized = kept.join(groups.select("lang", "source", "size"), ["lang", "source"]).join(langs, "lang")
    above = share(F.col("n"), F.col("size"), F.col("terms")) - share(F.col("total"), F.col("lang_size"), F.col("terms"))
    terms = sized.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    return pairs.select("*", ranked).unionAll(terms.select("*", ranked).where(F.col("rank") <= top_terms))


def digest(report: DataFrame) -> DataFrame:
    return report.select("lang", "source", "part", "item", "value", "rank")
