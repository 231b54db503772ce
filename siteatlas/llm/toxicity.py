"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if any sentence is.  A sentence's score is a logistic function of the words
in it and of how they begin; a document's is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels train it; the sentence scores
then say where the offending sentences are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import identified
from siteatlas.llm.words import WordBatch, table_of

# Bounds of the fitting sample: labelled documents of each label, and the longest text used.
SAMPLE_PER_LABEL = 3000
SAMPLE_TEXT_BYTES = 32 << 10
# Features besides whole words: the first so many bytes.
BEGINNINGS = (4, 6)

_LETTER = [c for c in range(256) if 97 <= c <= 122 or 65 <= c <= 90 or 48 <= c <= 57 or c >= 128 or c == 39]
_BREAKS = table_of(bytes(c for c in range(256) if c not in _LETTER))
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_STOPS = table_of(b".!?\n")


@dataclass
class Bags:
    """Words of a batch with their sentence, and sentences with their document."""

    words: np.ndarray         # hash of each word, then of the beginnings of words
    sentence: np.ndarray      # number of the sentence of each of these
    document: np.ndarray      # document of each sentence; every document has one at least
    spans: np.ndarray         # first and last byte of each sentence
    batch: WordBatch


def bags(texts: pa.Array) -> Bags:
    batch = WordBatch(texts, _BREAKS, _FOLD)
    n = len(batch)
    stops = np.flatnonzero(_STOPS[batch.data]) + 1
    begins = np.unique(np.concatenate([batch.bounds[:-1], stops[stops < len(batch.data)]]))
    # Empty texts share their place with the next one: each text gets a sentence of its own there.
    empty = np.flatnonzero(batch.bounds[1:] == batch.bounds[:-1])
    solid = np.flatnonzero(batch.bounds[1:] > batch.bounds[:-1])
    begins = begins[begins < len(batch.data)]
    owner = solid[np.searchsorted(batch.bounds[solid], begins, side="right") - 1] if len(solid) else np.zeros(0, dtype=np.int64)
    sentence = np.searchsorted(begins, batch.starts, side="right") - 1
    ends = np.concatenate([begins[1:], [len(batch.data)]]) if len(begins) else begins
    document = np.concatenate([owner, empty])
    spans = np.stack([np.concatenate([begins, batch.bounds[empty]]), np.concatenate([ends, batch.bounds[empty]])], axis=1)
    assert n == 0 or len(np.unique(document)) == n
    features = np.concatenate([batch.hashes(), *(batch.hashes(k) for k in BEGINNINGS)])
    return Bags(features, np.tile(sentence, 1 + len(BEGINNINGS)), document, spans, batch)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def logits(self, b: Bags) -> np.ndarray:
        """Of each sentence; a word counts once in a sentence."""
        out = np.full(len(b.document), self.bias)
        at = np.flatnonzero(self.maybe[b.words >> np.uint64(44)])
        if len(self.keys) and len(at):
            words = b.words[at]
            slot = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            known = self.keys[slot] == words
            pairs = np.unique(b.sentence[at][known] * len(self.keys) + slot[known])
            out += np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=len(out))
        return out


def noisy_or(logits: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) over each document's sentences, from log(1 - p) = -softplus(logit)."""
    return -np.expm1(-np.bincount(document, weights=np.logaddexp(0, logits), minlength=n))


def telling(b: Bags, labels: np.ndarray, most: int, surprise: float) -> np.ndarray:
    """The features that toxic documents have more often than chance explains: at most ``most`` hashes.

    Measured by the log-likelihood ratio of a feature's document counts against equal shares of both labels.
    """
    n, toxic = len(labels), int(labels.sum())
    keys, slot = np.unique(b.words, return_inverse=True)
    seen = np.unique(slot.astype(np.int64) * max(n, 1) + b.document[b.sentence])
    feature, document = seen // max(n, 1), seen % max(n, 1)
    both = np.bincount(feature, minlength=len(keys)).astype(float)
    ours = np.bincount(feature, weights=labels[document], minlength=len(keys))
    share = toxic / max(n, 1)

    def part(count, expected):
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = 2 * (part(ours, both * share) + part(both - ours, both * (1 - share)))
    ratio[ours <= both * share] = 0
    best = np.argsort(-ratio, kind="stable")[:most]
    return np.sort(keys[best[ratio[best] >= surprise]])


def fit_bags(b: Bags, labels: np.ndarray, most: int = 3000, surprise: float = 20.0, steps: int = 300, rate: float = 0.1,
             decay: float = 0.3) -> Model:
    """Adam on the noisy-or likelihood over the telling features; evidence only adds, so weights stay at 0 or above."""
    n = len(labels)
    keys = telling(b, labels, most, surprise)
    if not len(keys):
        share = float(np.clip(labels.mean() if n else 0.0, 1e-3, 0.999))
        per = max(len(b.document) / max(n, 1), 1)
        return Model(keys, np.zeros(0), float(np.log(np.expm1(-np.log1p(-share) / per))))
    number = np.minimum(np.searchsorted(keys, b.words), len(keys) - 1)
    used = keys[number] == b.words
    pairs = np.unique(b.sentence[used] * len(keys) + number[used])
    rows, cols = pairs // len(keys), pairs % len(keys)
    weights, moment, energy = (np.zeros(len(keys) + 1) for _ in range(3))
    weights[-1] = -5.0
    for step in range(1, steps + 1):
        z = weights[-1] + np.bincount(rows, weights=weights[cols], minlength=len(b.document))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.clip(noisy_or(z, b.document, n), 1e-9, 1)
        pull = np.where(labels == 1, -(1 - whole) / whole, 1.0)
        grad_z = p * pull[b.document]
        grad = np.concatenate([np.bincount(cols, weights=grad_z[rows], minlength=len(keys)) + decay, [grad_z.sum()]])
        moment = 0.9 * moment + 0.1 * grad
        energy = 0.99 * energy + 0.01 * grad * grad
        weights -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(energy / (1 - 0.99**step)) + 1e-6)
        weights[:-1] = np.maximum(weights[:-1], 0)
    kept = weights[:-1] > 0
    return Model(keys[kept], weights[:-1][kept], float(weights[-1]))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, text_bytes: int) -> DataFrame:
    """``text, toxic`` of the training documents: of each label the ``per_label`` with the smallest hash of their id.

    A document with several labels is toxic if one says so; labels other than 0 and 1, and null ids, are not used.  Of the texts of
    one id the one with the smallest hash is taken, by an aggregate that combines before the shuffle, so rows are bounded as ids are.
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    short = identified(docs).where(F.octet_length("text") <= text_bytes)
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    mine = short.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    one = mine.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", "t.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Fit on a bounded sample: at most ``2 * per_label`` ids, texts of at most ``text_bytes``; held-out ids never.

    The sample meets in one task, which returns the weights; they are all that reaches the driver.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = rows.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        model = fit_bags(bags(texts), rows.column("toxic").to_numpy())
        raw = pickle.dumps((model.keys.tobytes(), model.weights.astype("<f8").tobytes(), model.bias))
        return pa.table({"model": pa.array([raw], pa.binary())})

    chosen = sample(docs, labels, per_label, text_bytes)
    found = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: run(t.select(["doc_id", "text", "toxic"])), "model binary").first()
    if not found:
        return fit_bags(bags(pa.array([], pa.string())), np.zeros(0, dtype=np.int32))
    keys, weights, bias = pickle.loads(found["model"])
    return Model(np.frombuffer(keys, dtype=np.uint64), np.frombuffer(weights, dtype="<f8"), bias)


def score(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``doc_id, score, sentences``: the noisy-or score, and the sentences with a score of ``limit`` or more.

    ``sentences`` are ``{text, score}`` in text order.  Null or empty text: one empty sentence, scored by the bias alone.
    Repeated rows and ids: a row each; null ids stay null.  Empty table: no rows.  Other columns are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    found = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            b = bags(batch.column(1))
            z = own.logits(b)
            total = noisy_or(z, b.document, batch.num_rows)
            marked = [[] for _ in range(batch.num_rows)]
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            texts = batch.column(1)
            offsets = b.batch.bounds
            for s in np.flatnonzero(p >= limit):
                doc = int(b.document[s])
                raw = (texts[doc].as_py() or "").encode() if not marked[doc] else raw_of
                raw_of = raw
                first, last = b.spans[s] - offsets[doc]
                marked[doc].append({"text": raw[first:last].decode("utf-8", "replace").strip(), "score": float(p[s])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(total, 0, 1)), pa.array(marked, found)],
                                             names=["doc_id", "score", "sentences"])

    return identified(docs).mapInArrow(run, "doc_id long, score double, sentences array<struct<text:string,score:double>>")


def digest(scored: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("sentences").cast("long").alias("n_offending"))
