"""Results against SQL, brute force, exact round trips and held-out labels."""

import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from siteatlas.llm import checks, order_minhash, packing, queries, substrings, token_files, toxicity
from siteatlas.llm.common import prepare, table, tokenizer_file
from siteatlas.llm.components import components

import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))
TOKENIZER = tokenizer_file("word_bpe_49k.json")


def given(folder, name="documents", *columns):
    rows = ds.dataset(f"{folder}/{name}.parquet").to_table(columns=list(columns) or ["doc_id", "text"]).to_pylist()
    return [tuple(r.values()) for r in rows]


def encoded(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(checks.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


def test_token_files(spark):
    docs = sorted(given(SMALL))
    start, want = 0, []
    for (doc, _), ids in zip(docs, encoded([t for _, t in docs])):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op3_token_files(spark, SMALL).collect()) == want


@pytest.mark.parametrize("bits", [1, 8])
def test_planes(bits):
    for ids in ([0], [49407, 2, 0, 2**32 - 1], list(range(9000))):
        ids = np.array(ids, dtype="<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, 64, bits), len(ids), bits) == ids).all()


def test_long_documents_go_over_chunks(spark, tmp_path):
    prepare(spark)
    docs = [(1, "a b c"), (2, " ".join(["word"] * 5000)), (2, " ".join(["other"] * 3000)), (3, "")]
    token_files.write(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path), TOKENIZER, plane_bits=1, chunk_ids=700)
    got = {(r.n_tokens, r.ids_crc32) for r in token_files.digest(token_files.read(spark, str(tmp_path))).collect()}
    assert got == {(len(ids), crc(ids)) for ids in encoded([t for _, t in docs])}


def test_cut():
    for n in [*range(1, 5000), 40_000]:
        pieces = packing.cut(n, 4096)
        assert sum(pieces) == n and min(pieces) > 0 and max(pieces) <= 4096


def test_packing(spark):
    docs = dict(given(MIDDLE))
    ids = dict(zip(docs, encoded(list(docs.values()))))
    rows = packing.pack(table(spark, MIDDLE, "documents"), TOKENIZER).collect()
    pieces, bins = {}, {}
    for r in rows:
        own = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert own == ids[r.doc_id][r.start:r.start + r.length] and r.ids_crc32 == crc(own) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padding))
    for doc, parts in pieces.items():
        assert sorted(parts) == [(sum(n for _, n in sorted(parts)[:i]), sorted(parts)[i][1]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == len(ids[doc])
    padded = total = 0
    for parts in bins.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))]
        used = sum(p[1] for p in parts)
        assert used <= 4096 and sum(p[2] for p in parts) == (0 if used & (used - 1) == 0 else 4096 - used)
        padded, total = padded + sum(p[2] for p in parts), total + used
    assert set(pieces) == set(docs) and padded < 0.01 * total


def test_substrings(spark):
    prepare(spark)
    random.seed(5)
    shared = [f"w{random.randrange(50)}" for _ in range(400)]
    docs = []
    for i in range(60):
        w = [f"x{random.randrange(500)}" for _ in range(random.randrange(0, 120))]
        for _ in range(random.randrange(0, 3)):
            a, n, p = random.randrange(0, 370), random.randrange(10, 60), random.randrange(0, len(w) + 1)
            w[p:p] = shared[a:a + n]
        docs.append((1000 - 3 * i, " ".join(w)))
    docs += [(1, docs[7][1]), (8, "a " * 100), (9, "a b c d e f g " * 30), (10, " ".join(shared[:20])), (11, " ".join(shared[:19]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for block in (10, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove(rows, block=block).collect()}
        assert got == plain.without_repeats(docs)


def test_near_groups(spark):
    docs = sorted(given(SMALL))
    found = plain.groups([t for _, t in docs])
    want = {doc: docs[r][0] for (doc, _), r in zip(docs, found)}
    got = {r.doc_id: r.class_id for r in queries.op7_order_minhash(spark, SMALL).collect()}
    assert got == want
    kept = order_minhash.keep_one(table(spark, SMALL, "documents"))
    assert len(kept.collect()) == len(set(found))


def test_copies_of_copies(spark):
    """Copies with scattered edits: all of them in one class, documents that share a long passage apart."""
    prepare(spark)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(300)], [word() for _ in range(60)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(8):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in order_minhash.group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0}
    assert all(got[i] == i for i in range(100, 160))


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, rng.choice([2, 5, 30]), rng.integers(0, 40)).astype(np.uint64)
        b = list(a)
        for _ in range(rng.integers(0, 8)):
            p = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5 or not b:
                b.insert(p, 99)
            else:
                b.pop(min(p, len(b) - 1))
        b = np.array(b, dtype=np.uint64)
        true = plain.distance(list(a), list(b))
        assert order_minhash.chained_distance(a, b) >= true
        for most in (0, 3, 50):
            want = true if true <= most else None
            assert order_minhash.edit_distance(a, b, most) == want and order_minhash._rows(a, b, most) == want


def test_toxicity(spark):
    docs, labels = table(spark, LARGE, "documents"), dict(given(LARGE, "labels", "doc_id", "toxic"))
    model = toxicity.fit(docs, table(spark, LARGE, "labels"))
    rows = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in toxicity.digest(toxicity.score(docs, model)).collect() if r.held_out and r.doc_id in labels]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    false = sum(p for p, y in held if not y) / sum(not y for _, y in held)
    assert caught > 0.8 and false < 0.02
    marked = [s.text.lower() for r in rows for s in r.sentences if labels.get(r.doc_id) == 1]
    telling = sum(any(w in s for w in ("idiot", "moron", "scum", "trash", "stupid", "loser", "clown")) for s in marked)
    assert telling > 0.3 * len(marked)


def test_components(spark):
    prepare(spark)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3), (5, None)] + [(1000, i) for i in range(1001, 1400)]
    edges += [(i, i + 1) for i in range(2000, 2060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_pipeline(spark):
    """The stages one after another by brute force, over the whole small table."""
    docs = {d: t for d, t in given(SMALL) if plain.good(t)}
    docs = plain.without_line_runs(docs.items())
    order = sorted(docs)
    roots = plain.groups([docs[d] for d in order])
    docs = {order[r]: docs[order[r]] for r in set(roots)}
    items = [t for _, t in given(SMALL, "benchmark", "item_id", "text")]
    want = {d for d, t in docs.items() if not plain.leaked(t, items)}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    # Of a group the smallest (id, hash) stays: ids are unique here.
    assert set(got) == want
    for (doc, parts), ids in zip(sorted(got.items()), encoded([docs[d] for d in sorted(want)])):
        assert sum(n for _, n, _ in parts) == len(ids) == parts[0][2]


def test_copies_in_a_crowded_sketch(spark):
    """Pairs of near copies among many unlike texts with one passage: found, though they share little else."""
    prepare(spark)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    docs = []
    for i in range(150):
        own = [word() for _ in range(20)]
        docs.append((2 * i, " ".join([*own[:10], *passage, *own[10:]])))
        if i % 5 == 0:  # every other word of its own changed
            own[::2] = [word() for _ in own[::2]]
            docs.append((2 * i + 1, " ".join([*own[:10], *passage, *own[10:]])))
    got = {r.doc_id: r.class_id for r in order_minhash.group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_cells_pair_all(spark, monkeypatch):
    """The pairs of a sketch that is cut into bands and blocks, against all pairs of it."""
    prepare(spark)
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    lengths = [random.Random(4).randrange(5, 60) for _ in range(120)]
    rows = [(1, bytes([i]), n, bytes([i // 3])) for i, n in enumerate(lengths)]
    cells = {}
    for r in order_minhash._cells(spark.createDataFrame(rows, "key long, node binary, n long, root binary"), 0.8).collect():
        cells.setdefault((r.low, r.i, r.high, r.j), []).append((r.side, r.node[0]))
    met = [frozenset((x, y)) for c in cells.values() for s, x in c for t, y in c if (s, t) == (1, 2) or s == t == 0 and x < y]
    want = {frozenset((x, y)) for x in range(120) for y in range(x) if 5 * min(lengths[x], lengths[y]) >= 4 * max(lengths[x], lengths[y])}
    assert want <= set(met) and len(met) == len(set(met))


def test_lone_pairs_at_the_threshold():
    """Pairs with scattered edits, at the threshold and above it, have a key in common: surely up to 14 words, nearly so beyond."""
    rng = np.random.default_rng(1)

    def found(n, edits, kinds, pairs=400):
        made = []
        for _ in range(pairs):
            a = rng.integers(1, 2**63, n).astype(np.uint64)
            b = a.tolist()
            for at in sorted(rng.choice(n, edits, replace=False), reverse=True):
                kind, new = rng.choice(kinds), int(rng.integers(1, 2**63))
                if kind == "replace":
                    b[at] = new
                elif kind == "insert":
                    b.insert(at, new)
                else:
                    del b[at]
            b = np.array(b, dtype=np.uint64)
            if order_minhash.similar(a, b, 0.8):
                made += [a, b]
        keys = order_minhash.all_keys(np.concatenate(made), np.concatenate([[0], np.cumsum([len(x) for x in made])]), 0.8)
        return np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(keys[::2], keys[1::2], strict=True)])

    for n in (4, 5, 6, 9, 10, 12, 14):
        assert found(n, order_minhash.allowed(n, 0.8), ["replace"]) == 1 or n == 4
        assert found(n, 1 if n < 10 else 2, ["replace", "insert", "delete"]) == 1
    for n, edits, least in ((15, 3, 0.95), (20, 4, 0.95), (29, 5, 0.98), (30, 6, 0.95), (33, 6, 0.95), (300, 30, 1), (300, 45, 0.995), (300, 60, 0.98)):
        assert found(n, edits, ["replace"]) >= least, (n, edits)


def test_near_duplicates_of_a_frequent_passage(spark, monkeypatch):
    """Texts that share most of their words, in one long passage, become pairs only where their word counts leave a link open."""
    rng = random.Random(3)
    passage = [f"w{rng.randrange(300)}" for _ in range(560)]
    texts = [" ".join(passage + [f"x{rng.randrange(3000)}" for _ in range(220)]) for _ in range(60)]
    copies = [t.rsplit(" ", 20)[0] + " changed" for t in texts[:5]]
    pairs, verified = [], order_minhash._verified

    def counted(some, *args):
        pairs.append(some.count())
        return verified(some, *args)

    monkeypatch.setattr(order_minhash, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.group(docs).collect()}
    assert found == {i: i if i < 60 else i - 60 for i in range(65)}
    assert sum(pairs) < 200  # of 2,080


def test_word_counts_bound_the_distance():
    """Neither lists nor bins of words, nor a cell that holds too many of them, rule out a pair within the distance."""
    rng = random.Random(4)
    for sizes, held in (([30, 31, 29], 8_000_000), ([1999, 2001, 2100], 8_000_000), ([400, 402, 398], 30)):
        base = [f"w{rng.randrange(500)}" for _ in range(max(sizes))]
        texts = [" ".join(w if rng.random() < 0.9 else "other" for w in base[:k]) for k in sizes]
        hashes, first = order_minhash.word_hashes(pa.array(texts))
        before, order_minhash.HELD = order_minhash.HELD, held
        try:
            counts = order_minhash.word_counts(order_minhash.word_lists(hashes, first), np.array(sizes))
        finally:
            order_minhash.HELD = before
        for i, j in ((0, 1), (0, 2), (1, 2)):
            apart = order_minhash.edit_distance(*(hashes[first[k]:first[k + 1]] for k in (i, j)), max(sizes))
            assert order_minhash.near_words(counts, np.array([i]), np.array([j]), np.array([apart])).all()
    counts = order_minhash.word_counts(order_minhash.word_lists(*order_minhash.word_hashes(pa.array(["a b c d", "a b e f"]))), np.array([4, 4]))
    assert [bool(order_minhash.near_words(counts, np.array([0]), np.array([1]), np.array([m]))[0]) for m in (1, 2)] == [False, True]


def test_near_duplicates_take_a_batch_in_slices():
    """However many texts come in a batch, a worker sketches some at a time, to the same features."""
    texts = [f"text {i} of a batch with several words and the number {i % 7}" for i in range(600)]
    ids = pa.array(range(600), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], names=["doc_id", "text", "mark"])
    found = list(order_minhash._feature_rows(iter([batch]), 0.8))
    assert max(b.num_rows for b in found) <= order_minhash.FEATURED
    one_by_one = [b for k in range(600) for b in order_minhash._feature_rows(iter([batch.slice(k, 1)]), 0.8)]
    assert pa.Table.from_batches(found).to_pylist() == pa.Table.from_batches(one_by_one).to_pylist()


def test_pairs_of_many_sketches_are_made_once(spark, monkeypatch):
    """Texts that share nearly all of their sketches: a worker gives each pair out once, not once a sketch."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = [" ".join([*base[:5 * i], f"own{i}", *base[5 * i + 1:]]) for i in range(12)]
    given_out, pairs, real = [], set(), order_minhash._open_pairs

    def received(plan):
        children = plan.children()
        own = plan.metrics().apply("pythonNumRowsReceived").value() if plan.nodeName() == "MapInArrow" else 0
        return own + sum(received(children.apply(k)) for k in range(children.size()))

    def counted(known, *args):
        found = real(known.withColumn("root", known["node"]), *args)  # as if nothing were joined yet
        pairs.update((bytes(r.a), bytes(r.b)) for r in found.collect())
        given_out.append(received(found._jdf.queryExecution().executedPlan()))
        return found

    monkeypatch.setattr(order_minhash, "_open_pairs", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = order_minhash.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.class_id for r in found} == {0}
    assert len(pairs) == sum(given_out) == 66


def test_alignment_by_rows_in_blocks(monkeypatch):
    """Rows of a band against the whole table, also where a text's places are marked in several blocks."""
    monkeypatch.setattr(order_minhash, "MARKED", 64)
    rng = np.random.default_rng(5)
    for n, share in ((90, 0.1), (150, 0.2), (200, 0.3)):
        a = rng.integers(0, 40, n).astype(np.uint64)
        b = np.concatenate([a[7:], rng.integers(0, 40, 11).astype(np.uint64)])
        b[rng.random(len(b)) < share] = 99
        true = plain.distance(list(a), list(b))
        for band in (20, true - 1, true, true + 1, 300):
            want = true if true <= band else None
            assert order_minhash._rows(a, b, band) == want == order_minhash._rows(b, a, band)
