"""Ranked search against a full scan in plain Python, on odd rows and in many small blocks and batches."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from siteatlas.llm import ranked_search
from siteatlas.llm.common import prepare

CLASH = "doc_id long, text string, item_id long, score long, terms string, item int"


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())


def scan(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def random_rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "of", "a1b", "é中", "x"]
    pick = lambda m: " ".join(rng.choice(words[:rng.choice([5, 50, 305])]) + rng.choice(["", ",", "-"]) for _ in range(m))
    docs = [(i, pick(rng.choice([1, 5, 40, 200]))) for i in range(n)]
    docs += docs[:7] + [(None, "w1 w2 the"), (None, None), (n + 1, ""), (n + 2, "!?"), (n + 3, "The " * 5000)]
    items = [(i, pick(rng.choice([1, 8, 30]))) for i in range(25)] + [(3, "w1 of of of"), (None, "w2"), (90, None), (91, "--"), (92, "nowhere")]
    return docs, [*items, items[0]]


@pytest.mark.parametrize("k, block_bytes", [(10, 8 << 20), (3, 400)])
def test_equals_a_full_scan(spark, monkeypatch, k, block_bytes):
    monkeypatch.setattr(ranked_search, "RANKED_TOGETHER", 2)
    prepare(spark)
    docs, items = random_rows(k, 400)
    table = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], CLASH).repartition(5)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    got = ranked_search.search(table, asked, k, block_bytes=block_bytes).collect()
    assert sorted(repr(tuple(r)) for r in got) == scan(docs, items, k)


def test_empty_tables(spark):
    none, one = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([], [(1, "a b")]))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(one, items.where("false")).collect() == []
    assert ranked_search.search(one.withColumn("text", one.text.substr(0, 0)), items).collect() == []
    assert [tuple(r)[:3] for r in ranked_search.search(one, items).collect()] == [(1, 1, 1)]


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(200), 10)
    terms_ = np.concatenate([rng.choice(50, 10, replace=False) + 50 * (i % 4) for i in range(200)])
    weights = rng.integers(1, 1000, len(terms_))
    directions = ranked_search.principal(owner, terms_, weights, 200, 200)
    order, levels = ranked_search.build(owner, terms_, weights, 200, 200, directions, weights)
    dense = rng.integers(0, 50, 200)
    exact = levels[0].products(np.arange(200), dense)
    assert exact.tolist() == [int((weights[owner == i] * dense[terms_[owner == i]]).sum()) for i in order]
    for depth, level in enumerate(levels):
        bound = level.products(np.arange(len(level)), dense)
        assert all(bound[i // ranked_search.FANOUT ** depth] >= exact[i] for i in range(200))
    # Rows of one block of terms are neighbours: few leaves hold terms of two blocks.
    assert np.mean([len({i % 4 for i in order[a:a + 8]}) for a in range(0, 200, 8)]) < 2


def test_long_texts_pass_64_bits():
    items = ranked_search.Items([1], ranked_search.pa.array(["a"]), np.array([5]), 1 << 40, 1 << 41, np.ones((1, 1)), np.array([0]),
                                [ranked_search.Level(np.array([0, 1]), np.array([0]), np.array([5]))])
    state = ranked_search.Search(items, 1)
    state.take(np.array([7]), ranked_search.pa.array(["a " * 200_000]))
    m = 25 + 75 * 200_000 * (1 << 40) // (1 << 41)
    assert state.found().to_pylist() == [{"item": 0, "item_id": 1, "doc_id": 7, "score": 5 * (10**9 * 200_000 // (1000 * 200_000 + 8 * m))}]
