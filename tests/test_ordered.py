import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siteatlas.operators import archive, blocks, dedup, frontier, neardup, ordered, stats


def events(spark, n=400, seed=3):
    rng = random.Random(seed)
    kinds = ["success", "failure", "failure", "challenge", "skip"]
    rows = [(i, "hot" if rng.random() < 0.6 else f"d{rng.randrange(4)}", rng.choice(kinds), f"s{i % 3}",
             rng.choice(["HTTP 429", "timeout"]), rng.randrange(3)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "seq long, domain string, kind string, session_id string, error_message string, priority int").repartition(5)


def by_seq(df, *cols):
    return [tuple(r) for r in df.orderBy("seq").select("seq", *cols).collect()]


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_chunked_steps_equal_plain_windows(spark, rows):
    df = events(spark)
    plain = Window.partitionBy("domain").orderBy("seq")
    want = df.withColumn("n", F.sum(F.lit(1)).over(plain)).withColumn("p", F.lag("kind").over(plain))
    got = ordered.running_totals(df, ["domain"], [ordered.chunk_of("seq", rows)], ["seq"], {"n": F.lit(1)})
    assert by_seq(got, "n") == by_seq(want, "n")
    got = ordered.previous_row(df, ["domain"], [ordered.chunk_of("seq", rows)], ["seq"], ["kind"], "p")
    assert by_seq(got, "p.kind") == by_seq(want, "p")
    streak, left = {}, []
    for seq, domain, kind in [(r.seq, r.domain, r.kind) for r in df.orderBy("seq").collect()]:
        streak[domain] = 0 if kind == "success" else streak.get(domain, 0) + (kind == "failure")
        left.append((seq, streak[domain]))
    assert by_seq(blocks.failure_streaks(df, rows), "streak") == left
    health = {r.domain: r.failures for r in blocks.domain_health(df).collect()}
    assert health == streak


def test_first_n_and_marks(spark):
    df = events(spark).withColumn("key", F.when(F.col("domain") != "d0", F.col("domain")))
    marked = ordered.mark_first_n(df, ["key"], ["priority", "seq"], 3, "kept")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("priority", "seq"))
    want = df.withColumn("kept", F.col("key").isNull() | (rank <= 3))
    assert by_seq(marked, "kept") == by_seq(want, "kept")


def test_error_budget(spark):
    df = events(spark)
    got = {r.seq for r in blocks.within_error_budget(df, 5, 9).collect()}
    seen, want = {}, set()
    for r in df.orderBy("seq").collect():
        if seen.get(r.session_id, 0) < 5:
            want.add(r.seq)
        seen[r.session_id] = seen.get(r.session_id, 0) + (r.kind == "failure")
    assert got == want


def test_quota_finds_the_exact_cut(spark):
    rng = random.Random(1)
    base = 1_700_000_000_000_000
    rows = [(i, f"s{i}", base + rng.choice([0, 1, 2, 86_400_000_000, 86_400_000_500, 90_000_000_000]), rng.randrange(1, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, snapshot_id string, us long, total_size_bytes long").withColumn("captured_at", F.timestamp_micros("us"))
    total = sum(r[3] for r in rows)
    for limit in (0, 1, total // 3, total - 1, total, total + 5):
        size, want = total, set()
        for seq, name, _, bytes_ in sorted(rows, key=lambda r: (r[2], r[0])):
            if size <= limit:
                break
            want.add(name)
            size -= bytes_
        assert {r.snapshot_id for r in archive.over_quota(df, limit).collect()} == want, limit


def test_pattern_cap(spark):
    urls = [f"https://example.com/products/{i}" for i in range(1, 5)] + ["https://example.com/categories/1", "nope", "nope"]
    rows = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    got = stats.pattern_cap(rows).orderBy("seq").collect()
    assert [r.kept for r in got] == [True, True, True, False, True, True, True]
    assert got[3].reason.startswith("Pattern 'https://example.com/products/:id' already crawled 3 times")


def greedy(points, threshold=0.85, memory=None):
    kept, shapes, out = [], set(), {}
    for seq, title, links, forms, length in sorted(points):
        def near(k):
            ratio = 1.0 - min(abs(k[3] - length) / max(k[3], length), 1.0) if max(k[3], length) else 1.0
            same = 0.4 if k[0] == title else 0.0
            return same + (1.0 - min(abs(k[1] - links) + abs(k[2] - forms), 20) / 20.0) * 0.3 + ratio * 0.3 >= threshold
        shape = (title, links, forms)
        out[seq] = shape not in shapes and not any(near(k) for k in kept)
        if out[seq]:
            kept.append((title, links, forms, length))
            shapes.add(shape)
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.75, 0.95])
def test_near_duplicates_equal_the_sequential_rule(spark, threshold):
    rng = random.Random(int(threshold * 100))
    points = [(i, "Untitled" if rng.random() < 0.7 else f"t{rng.randrange(5)}", rng.randrange(0, 30), rng.randrange(0, 4),
               rng.choice([0, 10, 50, 100, 190, 200, 400, 1000, 5000])) for i in range(220)]
    rng.shuffle(points)
    df = spark.createDataFrame(points, "seq long, title string, links int, forms int, length int").withColumn("url", F.lit("https://e.com/"))
    got = {r.seq: r.kept for r in dedup.near_duplicates(df, threshold).collect()}
    assert got == greedy(points, threshold)


@pytest.mark.parametrize("block", [1, 7, 40])
def test_blocks_of_any_size_settle_alike(spark, block):
    rng = random.Random(block)
    points = [(i, "Untitled" if rng.random() < 0.7 else None, rng.randrange(0, 60), rng.randrange(0, 4),
               rng.choice([0, 100, 190, 200, 400])) for i in range(150)]
    seen, unique = set(), []
    for p in points:
        if p[1:] not in seen:
            seen.add(p[1:])
            unique.append(p)
    df = spark.createDataFrame(unique, "seq long, title string, links int, forms int, length int").na.fill("", ["title"])
    kept, _ = neardup.settle(df, 0.85, 10, block)
    want = greedy([(s, t or "", a, f, n) for s, t, a, f, n in unique])
    assert {r.seq for r in kept.collect()} == {s for s, k in want.items() if k}


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, order):
    """5,000 classes of one title, each a rival of its neighbours only, in 100 blocks."""
    n = 5000
    seqs = {"forward": list(range(n)), "backward": list(range(n, 0, -1)), "mixed": random.Random(1).sample(range(n), n)}[order]
    points = [(seq, "T", 10 * i, 0, 100) for i, seq in enumerate(seqs)]
    steps = []
    real = neardup.cut_lineage
    monkeypatch.setattr(neardup, "cut_lineage", lambda df, name: steps.append(name) or real(df, name))
    df = spark.createDataFrame(points, "seq long, title string, links int, forms int, length int")
    kept, rounds = neardup.settle(df, 0.85, 10, 50)
    assert {r.seq for r in kept.collect()} == {s for s, k in chained(points).items() if k}
    assert rounds + steps.count("near-ties") < 20


def chained(points):
    """The rule where only neighbours by link count are rivals."""
    at = {links: seq for seq, _, links, _, _ in points}
    out = {}
    for seq, _, links, _, _ in sorted(points):
        out[seq] = not any(out.get(at.get(links + d), False) for d in (-10, 10))
    return out


def test_near_duplicates_need_a_high_threshold(spark):
    with pytest.raises(ValueError):
        dedup.max_distance(0.6)


def test_redirects(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "a", "d"), (4, "x", "x"), (5, "y", "z")], "seq long, start string, final string")
    assert {r.url for r in frontier.redirect_loops(pairs, 3).collect()} == {"b", "c", "d"}
    assert frontier.recorded_redirects(pairs).count() == 4
    assert [(r.hop, r.final) for r in frontier.redirect_chains(pairs, 2).where("start = 'a'").orderBy("hop").collect()] == [(1, "b"), (2, "c"), (3, "d")]


def test_depths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (9, 8)], "src long, dst long")
    got = {r.node: r.depth for r in frontier.depths(edges, spark.createDataFrame([(0,)], "node long"), 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_stats(spark):
    rows = [(1, "s", "a.com", "success", 100.0, None, None), (2, "s", "a.com", "success", 200.0, None, None), (3, "s", "a.com", "failure", 0.0, "Error", "boom"),
            (4, "s", "b.com", "challenge", 0.0, None, None), (5, "s", "b.com", "skip", 0.0, None, None), (6, "s", "a.com", "retry", 0.0, None, None),
            (7, "s", "a.com", "failure", 0.0, "Error", "boom")]
    df = spark.createDataFrame(rows, "seq long, session_id string, domain string, kind string, duration_ms double, error_type string, error_message string")
    df = df.withColumn("event_time", F.timestamp_micros(F.col("seq") * 60_000_000)).withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/")))
    s = stats.crawl_stats(df).first()
    assert (s.total_requests, s.success_count, s.failed_count, s.skipped_count, s.retry_count, s.avg_processing_ms) == (5, 2, 2, 1, 1, 150)
    assert s.requests_per_minute == 0.8
    assert [r.domain for r in stats.domain_stats(df).collect()] == ["a.com"]
    g = stats.grouped_errors(df).first()
    assert (g.error_key, g.errors, g.urls) == ("Error: boom", 2, ["https://a.com/"] * 2)
