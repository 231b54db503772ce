"""Source divergence against plain sums, on odd rows, in small chunks, and of single columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from siteatlas.llm import divergence

CLASH = "doc_id long, text string, lang string, source string, n long, total long, term string, number int, size long"


def plain(rows, least, top):
    words = lambda t: re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    docs = [(lang or "", source or "", Counter(w.decode() for w in words(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(w for a, _, bag in docs if a == lang for w in bag)
        kept = [w for w, n in held.items() if n >= least]
        groups = defaultdict(Counter)
        for a, source, bag in docs:
            if a == lang:
                groups[source].update({w: n for w, n in bag.items() if held[w] >= least})
        whole = sum(groups.values(), Counter())
        share = lambda bag: {w: 1 + 10**9 * (bag[w] + 5) // (sum(bag.values()) + 5 * len(kept)) for w in kept}
        q = share(whole)
        p = {s: share(bag) for s, bag in groups.items()}
        for s in groups:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in groups if o != s]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "term", w, -v, r + 1) for r, (v, _, w) in enumerate(sorted(terms)[:top])]
    return sorted(map(repr, out))


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["The", "é中", "ñ"]
    rows = []
    for i in range(300):
        source = None if i % 50 == 0 else "s0" if i % 3 else f"s{i % 11}"
        text = " ".join(rng.choice(words[:rng.choice([4, 30, 123])]) for _ in range(rng.choice([0, 3, 40])))
        rows.append((text, rng.choice(["en", "en", "de", None]), source))
    return [*rows, (None, "en", "only null"), ("", "xx", "a"), ("one two", "xx", "b"), ("one two", "yy", None), *rows[:5], ("the " * 3000, "de", "s1")]


@pytest.mark.parametrize("chunk_terms, least, top", [(4096, 5, 50), (7, 3, 4)])
def test_equals_plain_sums(spark, monkeypatch, chunk_terms, least, top):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk_terms)
    monkeypatch.setattr(divergence, "COMBINED", 200)
    rows = rows_of(least)
    docs = spark.createDataFrame([(i, t, a, s, 1, 2, "t", 3, 4) for i, (t, a, s) in enumerate(rows)], CLASH).repartition(4)
    got = divergence.digest(divergence.audit(docs, least, top)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows, least, top)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], CLASH)).collect() == []


def test_runs_give_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.repeat(rng.integers(0, 4, 12), rng.integers(1, 6, 12))[:24] for _ in range(2))
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        assert divergence.apart(divergence.runs(a), divergence.runs(b), n) == int(np.abs(a - b).sum())


def test_shares_pass_64_bits(spark):
    n, size, terms = 9_300_000_000_000, 10**17, 12_345
    want = 1 + 10**9 * (n + 5) // (size + 5 * terms)
    assert divergence._shares(np.array([n]), size, terms).tolist() == [want]
    row = spark.createDataFrame([(n, size, terms)], "n long, size long, terms long")
    assert row.select(divergence.share(row.n, row["size"], row.terms).alias("p")).first()["p"] == want


def test_equal_counts_are_neighbours(spark):
    """Two kinds of terms, dealt alphabetically one after the other: each column is two runs."""
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300) if i % 2 == s) + " zz", "en", f"s{s}") for s in (0, 1)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = divergence.kept_counts(docs, 1)
    groups, _ = divergence.group_sizes(docs, kept)
    chunks = divergence.run_columns(kept, groups).collect()
    assert sum(len(s) for c in chunks for s in c.starts) <= 8 * len(chunks)
