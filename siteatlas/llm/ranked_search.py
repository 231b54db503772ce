"""Exact ranked lexical search by a dual tree.

A document holds an integer weight c for each of its terms, an item an integer weight w times its repeats, and a score is the sum of
the products, so no coordinate is negative.  Items form a tree, and each task builds one over each batch of its documents; a node
holds the largest coordinate of each term below it, so the product of two nodes is an upper bound of every score between them.  The
trees are descended together: a pair of nodes whose bound is below the weakest kth score of its items goes with all it holds, and
what arrives at single items and documents is the exact score.  Nothing else is cut, so the result is that of a full scan.

Documents are read twice, for counts (documents, terms, documents of each item term) and for the search, and never shuffled.  A task
emits at most k rows an item, and these are ranked in two steps.  Items are taken in blocks of ``BLOCK_BYTES`` of distinct terms, each
with passes of its own over the documents; a block's terms and counts go through the driver, its size bounds what is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import identified
from siteatlas.llm.encoding import ranges
from siteatlas.llm.terms import ALPHANUMERIC, TermBatch, counted
from siteatlas.session import cut_lineage

K = 10
BLOCK_BYTES = 8 << 20
FANOUT, DIRECTIONS, ROUNDS = 8, 6, 6
# Tasks whose rows of an item are ranked together in the first of the two steps.
RANKED_TOGETHER = 256
_DOCS_WITH_TERMS, _ALL_TERMS = -1, -2
_LEAST = -(1 << 63)


# ---- trees

@dataclass
class Level:
    """Sparse rows: the entries of node i are ``terms`` and ``weights`` at ``first[i]:first[i + 1]``."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def above(self, width: int) -> Level:
        """The nodes over ``FANOUT`` neighbours each, with the largest weight of each term."""
        n = -(-len(self) // FANOUT)
        node = np.repeat(np.arange(len(self)) // FANOUT, np.diff(self.first))
        key = node * width + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        weights = np.maximum.reduceat(self.weights[order], begin) if len(key) else self.weights
        key = key[begin]
        return Level(np.searchsorted(key, np.arange(n + 1) * width), key % width, weights)

    def products(self, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Product of each node with a dense row."""
        sizes = self.first[nodes + 1] - self.first[nodes]
        at = ranges(self.first[nodes], sizes)
        sums = np.concatenate([[0], np.cumsum(dense[self.terms[at]] * self.weights[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def principal(owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, width: int) -> np.ndarray:
    """The directions in which the rows' unit vectors spread most, by subspace iteration."""
    unit = weights / np.maximum(np.sqrt(np.bincount(owner, weights.astype(np.float64) ** 2, minlength=n)), 1e-9)[owner]
    found = np.random.default_rng(17).standard_normal((min(DIRECTIONS, width), width))
    for _ in range(ROUNDS):
        rows = [np.bincount(owner, unit * d[terms], minlength=n) for d in found]
        back = np.stack([np.bincount(terms, unit * r[owner], minlength=width) for r in rows])
        found = np.linalg.qr(back.T)[0].T
    return found


def _near_together(owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, directions: np.ndarray) -> np.ndarray:
    """An order of the rows in which like rows tend to be neighbours: halves, quarters, ... are cut at the median of the direction
    in which the part spreads most."""
    points = np.stack([np.bincount(owner, weights * d[terms], minlength=n) for d in directions])
    points /= np.maximum(np.sqrt(np.bincount(owner, weights.astype(np.float64) ** 2, minlength=n)), 1e-9)
    order, parts = np.arange(n), 1
    while parts * FANOUT < n:
        part, now = np.arange(n) * parts // n, points[:, order]
        size = np.bincount(part, minlength=parts)
        mean = np.stack([np.bincount(part, p, minlength=parts) for p in now]) / size
        spread = np.stack([np.bincount(part, (p - m[part]) ** 2, minlength=parts) for p, m in zip(now, mean, strict=True)])
        widest = spread.argmax(axis=0)
        order = order[np.lexsort((now[widest[part], np.arange(n)], part))]
        parts *= 2
    return order


def build(owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, width: int, directions: np.ndarray,
          guide: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """``order`` of the rows and the levels over it, single rows first; ``guide`` are the weights that place rows near each other."""
    order = _near_together(owner, terms, guide, n, directions)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    by = np.argsort(place[owner], kind="stable")
    first = np.searchsorted(place[owner][by], np.arange(n + 1))
    levels = [Level(first, terms[by], weights[by])]
    while len(levels[-1]) > FANOUT:
        levels.append(levels[-1].above(width))
    return order, levels


# ---- items

@dataclass
class Items:
    """A block of items as a tree over terms of known weight, and the counts of the corpus."""

    ids: list
    terms: pa.Array
    weight: np.ndarray
    docs: int
    total: int
    directions: np.ndarray
    order: np.ndarray
    levels: list[Level]


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, terms, repeats`` of every distinct item that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = TermBatch(batch.column(1), ALPHANUMERIC)
            text, number, count = counted(np.repeat(np.arange(batch.num_rows), found.sizes()), found.number, len(found.spelled))
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(offsets, found.spelled.take(pa.array(number)).cast(pa.string()))
            repeats = pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, repeats], names=["item_id", "terms", "repeats"])

    rows = identified(items, id_col, text_col).distinct()
    return rows.mapInArrow(run, "item_id long, terms array<string>, repeats array<long>").where("size(terms) > 0")


def _slots(found: TermBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word of a batch that is one of ``terms``."""
    slot = pc.fill_null(pc.index_in(found.spelled, value_set=terms), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(found.first) - 1), found.sizes())
    slot = slot[found.number] if len(found.number) else np.zeros(0, dtype=np.int64)
    return text[slot >= 0], slot[slot >= 0]


def corpus_counts(docs: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each of ``terms``: sums of one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        holding, filled, total = np.zeros(len(known), dtype=np.int64), 0, 0
        for batch in batches:
            found = TermBatch(batch.column(0), ALPHANUMERIC)
            filled += int((found.sizes() > 0).sum())
            total += len(found.number)
            _, slot, _ = counted(*_slots(found, known), len(known))
            holding += np.bincount(slot, minlength=len(known))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([[_DOCS_WITH_TERMS, _ALL_TERMS], some]).astype(np.int64)),
            pa.array(np.concatenate([[filled, total], holding[some]]).astype(np.int64))], names=["slot", "n"])

    sums = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = {r["slot"]: r["n"] for r in sums.collect()}  # a row for each term of the block, and two
    holding = np.zeros(len(terms), dtype=np.int64)
    for slot, n in got.items():
        if slot >= 0:
            holding[slot] = n
    shared.unpersist()
    return got.get(_DOCS_WITH_TERMS, 0), got.get(_ALL_TERMS, 0), holding


def _prepared(block: pa.Table, docs: DataFrame) -> Items | None:
    coded = block.column("terms").combine_chunks().flatten().dictionary_encode()
    terms, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(block.column("terms")).to_numpy()
    repeats = block.column("repeats").combine_chunks().flatten().to_numpy()
    n_docs, total, holding = corpus_counts(docs, terms)
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = repeats * weight[number]
    directions = principal(owner, number, weights, len(sizes), len(terms))
    order, levels = build(owner, number, weights, len(sizes), len(terms), directions, weights)
    return Items(block.column("item_id").to_pylist(), terms, weight, n_docs, total, directions, order, levels)


# ---- search

class Search:
    """The best documents of every item among those met so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        n = len(items.ids)
        self.kth = np.ones(n, dtype=np.int64)  # by place in the tree; a score must be above 0
        self.scores = [np.zeros(0, dtype=np.int64) for _ in range(n)]
        self.docs = [np.zeros(0, dtype=np.int64) for _ in range(n)]
        self.dense = np.zeros(len(items.terms), dtype=np.int64)
        self.products = 0

    def take(self, doc_ids: np.ndarray, texts: pa.Array) -> None:
        items, width = self.items, len(self.items.terms)
        found = TermBatch(texts, ALPHANUMERIC)
        sizes = found.sizes()
        owner, terms, tf = counted(*_slots(found, items.terms), width)
        if not len(owner):
            return
        grown = 75 * items.docs * int(sizes.max())
        share = sizes.astype(object) if grown >= 1 << 62 else sizes  # beyond 64 bits Python's integers go on
        length = (25 + (75 * share * items.docs) // items.total).astype(np.int64)
        weights = (1_000_000_000 * tf) // (1000 * tf + 8 * length[owner])
        order, levels = build(owner, terms, weights, len(texts), width, items.directions, weights * items.weight[terms])
        self.ids, self.levels = doc_ids[order], levels
        top = len(items.levels) - 1
        every = np.arange(len(levels[-1]))
        for node in range(len(items.levels[top])):
            self._visit(top, node, len(levels) - 1, every)

    def _visit(self, item_level: int, node: int, doc_level: int, docs: np.ndarray) -> None:
        """Descend from an item node and document nodes; the deeper tree goes first, documents where both are level."""
        level, size = self.items.levels[item_level], FANOUT ** item_level
        at = slice(level.first[node], level.first[node + 1])
        self.dense[level.terms[at]] = level.weights[at]
        bound = self.levels[doc_level].products(docs, self.dense)
        self.dense[level.terms[at]] = 0
        self.products += len(docs)
        keep = bound >= self.kth[node * size:(node + 1) * size].min()
        docs = docs[keep]
        if not len(docs):
            return
        if item_level == 0 and doc_level == 0:
            self._rank(node, docs, bound[keep])
        elif doc_level >= item_level:
            below = (docs[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            self._visit(item_level, node, doc_level - 1, below[below < len(self.levels[doc_level - 1])])
        else:
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(self.items.levels[item_level - 1]))):
                self._visit(item_level - 1, child, doc_level, docs)

    def _rank(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], self.ids[docs]])
        best = np.lexsort((ids, -scores))[:self.k]
        self.scores[item], self.docs[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.kth[item] = scores[best[-1]]

    def found(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.scores]
        item = np.repeat(self.items.order, sizes)
        docs = np.concatenate([*self.docs, np.zeros(0, dtype=np.int64)])
        scores = np.concatenate([*self.scores, np.zeros(0, dtype=np.int64)])
        return pa.RecordBatch.from_arrays([
            pa.array(item.astype(np.int64)), pa.array([self.items.ids[i] for i in item], pa.int64()),
            pa.array(docs, mask=docs == _LEAST), pa.array(scores)], names=["item", "item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, by falling score, equal scores by rising doc_id.

    Null and empty texts have no terms: such documents count nowhere and such items have no rows, nor have items without a document
    of score above 0.  Texts of any length are taken whole.  Repeated document rows are documents each; items equal in id and text
    are one, those of one id and different texts are ranked each.  A null doc_id comes first among equals and stays null.  Empty
    tables: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = identified(docs)
    given = cut_lineage(item_rows(items, item_col, "text"), "ranked-items")
    size = given.agg(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t) + 16)")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes)
    found = None
    for number in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "terms", "repeats"), F.lit(blocks)) == number
        block = given.where(mine).toArrow()
        ready = _prepared(block, rows) if block.num_rows else None
        if ready is not None:
            best = _ranked(_block_rows(rows, ready, k), k)
            found = best if found is None else found.unionAll(best)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return empty if found is None else found


def _block_rows(docs: DataFrame, items: Items, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(shared.value, k)
        for batch in batches:
            state.take(pc.fill_null(batch.column(0), _LEAST).to_numpy(), batch.column(1))
        yield state.found()

    return docs.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = rows.withColumn("part", F.floor(F.spark_partition_id() / RANKED_TOGETHER))
    near = dealt.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def digest(found: DataFrame) -> DataFrame:
    return found.select("item_id", "rank", "doc_id", "score")
