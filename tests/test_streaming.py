"""Streams: listeners, first sightings without a window."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteatlas.streaming import jobs, limits, listeners, seen, similar

CRAWL = "seq long, kind string, url string, event_time timestamp"
KINDS = ["success", "failure", "skip", "challenge", "other"]


def crawl_files(spark, folder, files):
    """One file for each list of rows, in this order of arrival."""
    for i, rows in enumerate(files):
        part = f"{folder}-part"
        spark.createDataFrame(rows, CRAWL).coalesce(1).write.mode("overwrite").parquet(part)
        os.makedirs(folder, exist_ok=True)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = os.path.join(folder, f"f{i}.parquet")
        os.rename(os.path.join(part, name), target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))


def rows_over(days, n, seed):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(i, rng.choice(KINDS), f"https://e.com/p/{rng.randrange(n // 3)}" + rng.choice(["", "/", "#x"]),
             start + datetime.timedelta(days=days * i / n)) for i in range(n)]


def test_listeners_hear_every_batch(spark, tmp_path):
    rows = rows_over(1, 90, 1)
    crawl_files(spark, str(tmp_path / "in"), [rows[:20], rows[20:70], rows[70:]])
    failed, every = [], []
    heard = listeners.Listeners().on("page:failed", failed.append).on("*", every.append)

    def broken(event):
        raise ValueError(event["event"])

    heard.on(listeners.COMPLETED, broken)
    stream = jobs.read_files(spark, str(tmp_path / "in"), CRAWL, per_trigger=1)
    listeners.run_listened(stream, str(tmp_path / "out"), heard)
    parts = [rows[:20], rows[20:70], rows[70:]]
    assert [(e["batch"], e["rows"]) for e in failed] == [(i, sum(r[1] == "failure" for r in p)) for i, p in enumerate(parts)]
    assert [e["rows"] for e in every if e["event"] == listeners.PROGRESS] == [20, 50, 20]
    assert every[0]["event"] == listeners.STARTED and every[-1]["event"] == listeners.COMPLETED and every[-1]["rows"] == 3
    assert [(name, str(error)) for name, error in heard.failures] == [(listeners.COMPLETED, listeners.COMPLETED)]
    saved = spark.read.parquet(str(tmp_path / "out/events"))
    assert saved.count() == len(every) and not heard.rows
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 90


def test_a_listener_that_left_hears_nothing(spark, tmp_path):
    crawl_files(spark, str(tmp_path / "in"), [rows_over(1, 9, 2)])
    told = []
    heard = listeners.Listeners().on("*", told.append)
    heard.off("*", told.append)
    listeners.run_listened(jobs.read_files(spark, str(tmp_path / "in"), CRAWL), str(tmp_path / "out"), heard)
    assert told == []


def test_a_failed_stream_tells_so(spark, tmp_path):
    crawl_files(spark, str(tmp_path / "in"), [rows_over(1, 9, 3)])
    told = []
    heard = listeners.Listeners().on(listeners.ERROR, told.append)

    def write(batch, number):
        raise RuntimeError("disk is full")

    with pytest.raises(Exception, match="disk is full"):
        listeners.run_listened(jobs.read_files(spark, str(tmp_path / "in"), CRAWL), str(tmp_path / "out"), heard, write)
    assert len(told) == 1 and "disk is full" in told[0]["detail"]
    assert spark.read.parquet(str(tmp_path / "out/events")).where(F.col("event") == listeners.ERROR).count() == 1


def test_first_sightings_need_no_window(spark, tmp_path):
    """Sixty days of events in files out of order, one a micro-batch, merged on the way, the stream stopped in between."""
    rows = rows_over(60, 700, 4)
    files = [rows[i * 100:(i + 1) * 100] for i in (3, 0, 6, 1, 5, 2, 4)]
    found = None
    for some in (files[:4], files):
        crawl_files(spark, str(tmp_path / "in"), some)
        stream = jobs.read_files(spark, str(tmp_path / "in"), CRAWL, per_trigger=1)
        found = seen.store_first_sightings(stream, str(tmp_path / "out"), ["seq"], buckets=8, merge_every=2)
    got = sorted((r.normalized, r.seq) for r in found.collect())
    first = {}
    for file in files:
        for seq, _, url, _ in file:
            first.setdefault(url.split("#")[0].rstrip("/"), seq)
    assert got == sorted(first.items())
    left = sorted(os.listdir(tmp_path / "out/seen/keys/kind=update"))
    assert [x for x in left if x.startswith("batch=")] == ["batch=6"]


def test_a_retried_batch_counts_once(spark, tmp_path):
    table = seen.SeenTable(spark, str(tmp_path), buckets=4, merge_every=2)
    key = lambda *names: spark.createDataFrame([(n,) for n in names], "normalized string")
    names = lambda df: sorted(r.normalized for r in df.collect())
    for number, (asked, new) in enumerate([("ab", "ab"), ("bc", "c"), ("cd", "d"), ("abcde", "e")]):
        for _ in range(2):
            table.merge(number)
            fresh = table.unseen(key(*asked), number)
            assert names(fresh) == sorted(new)
            table.add(fresh, number)


def test_filters_grow_and_never_forget():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    none = pa.Table.from_pylist([], pa.schema([("bucket", pa.int32()), ("layer", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]))
    filters, every = none, []
    for _ in range(5):
        h = rng.integers(-2**63, 2**63, (2, 5000))
        keys = pa.table({"bucket": pa.array([3] * 5000, pa.int32()), "h1": h[0], "h2": h[1]})
        changed = seen._grown(keys, filters)
        kept = [r for r in filters.to_pylist() if r["layer"] not in changed.column("layer").to_pylist()]
        filters = pa.Table.from_pylist(kept + changed.to_pylist(), none.schema)
        every.append(keys)
    assert sorted((r["layer"], r["n"]) for r in filters.to_pylist()) == [(0, 4096), (1, 8192), (2, 25000 - 4096 - 8192)]
    assert all(seen._asked(k, filters).column("maybe").to_pylist() == [True] * 5000 for k in every)
    h = rng.integers(-2**63, 2**63, (2, 5000))
    strange = seen._asked(pa.table({"bucket": pa.array([3] * 5000, pa.int32()), "h1": h[0], "h2": h[1]}), filters)
    assert sum(strange.column("maybe").to_pylist()) < 250


def token_rule(rows, most, window_ms, idle_ms):
    """One request after another, in whole parts of a token."""
    state, out = {}, {}
    for seq, key, ms in rows:
        tokens, at = state.get(key, (most * window_ms, ms))
        ms = max(ms, at)
        tokens = most * window_ms if ms - at > idle_ms else min(most * window_ms, tokens + (ms - at) * most)
        allowed = tokens >= window_ms
        tokens -= window_ms if allowed else 0
        state[key] = (tokens, ms)
        out[seq] = (allowed, tokens // window_ms)
    return out


def request_rows(seed, n, hot=0.5):
    rng, ms, rows = random.Random(seed), 0, []
    for seq in range(n):
        ms += rng.choice([0, 1, 7, 40, 200]) if rng.random() > 0.01 else rng.choice([900, 4000])
        rows.append((seq, "hot" if rng.random() < hot else f"k{rng.randrange(6)}", ms - rng.choice([0, 0, 0, 30])))
    return rows


@pytest.mark.parametrize("short", [0, 64])
def test_flows_in_lists_and_arrays(monkeypatch, short):
    """A function of few pieces is kept as lists, of more as arrays, to the same end."""
    monkeypatch.setattr(limits, "SHORT", short)
    test_flows_compose(20, 700)


@pytest.mark.parametrize("most, window_ms", [(3, 1000), (20, 700), (1, 50)])
def test_flows_compose(most, window_ms):
    """The function of a stretch gives what its requests give one after another, for every number of tokens before it."""
    bucket = limits.Bucket(most, window_ms, 3000)
    ms = [max(r[2] for r in request_rows(most, i + 1)) for i in range(200)]
    flow = bucket.flow(ms)
    assert len(flow.low) <= 2 * most + 4
    for tokens in range(0, bucket.full + 1, 7):
        allowed, left = bucket.decide(tokens, ms)
        end = tokens
        for i, now in enumerate(ms):
            end = bucket.refilled(end, now - ms[i - 1]) if i else end
            end -= bucket.cost if end >= bucket.cost else 0
        assert flow.after(tokens) == end and left[-1] == end // bucket.cost


@pytest.mark.parametrize("chunk_rows", [1, 13, 10_000])
def test_rate_limits_cut_a_busy_key(spark, tmp_path, monkeypatch, chunk_rows):
    rows = request_rows(chunk_rows, 600)
    largest = []
    schema = "seq long, key string, event_time timestamp"
    for i, part in enumerate((rows[:250], rows[250:300], rows[300:])):
        made = spark.createDataFrame(part, "seq long, key string, ms long").select("seq", "key", F.timestamp_millis("ms").alias("event_time"))
        made.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        found = limits.store_rate_limits(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), 3, 1000, 3000,
                                         late_ms=10_000, chunk_rows=chunk_rows)
        largest.append(spark.read.parquet(str(tmp_path / "out/flows")).where("key = 'hot'").count())
    assert {r.seq: (r.allowed, r.remaining) for r in found.collect()} == token_rule(rows, 3, 1000, 3000)
    # The busy key's requests were not worked out in one piece.
    assert largest[0] == len({r[0] // chunk_rows for r in rows[:250] if r[1] == "hot"})


def test_rate_limits_of_many_light_keys(spark, tmp_path):
    """Keys with a few requests far apart are one piece each, not one a request."""
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(40)}", i * 20 - rng.choice([0, 0, 70])) for i in range(400)]
    schema = "seq long, key string, event_time timestamp"
    spark.createDataFrame(rows, "seq long, key string, ms long").select("seq", "key", F.timestamp_millis("ms").alias("event_time")).write.parquet(
        str(tmp_path / "in"))
    found = limits.store_rate_limits(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), 3, 1000, 3000, chunk_rows=30)
    assert {r.seq: (r.allowed, r.remaining) for r in found.collect()} == token_rule(rows, 3, 1000, 3000)
    assert spark.read.parquet(str(tmp_path / "out/flows")).count() == len({r[1] for r in rows})


def test_rate_limits_without_times(spark, tmp_path):
    """A request without a time counts as of the one before it; those without key or seq are nobody's."""
    rows = [(0, "a", None), (1, "a", 100), (2, "a", None), (3, "a", 100), (4, "a", 2100), (5, "b", None), (None, "a", 5), (6, None, 5)]
    schema = "seq long, key string, event_time timestamp"
    spark.createDataFrame(rows, "seq long, key string, ms long").select("seq", "key", F.timestamp_millis("ms").alias("event_time")).write.parquet(
        str(tmp_path / "in"))
    for chunk_rows in (1, 100):
        found = limits.store_rate_limits(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / f"out{chunk_rows}"), 3, 3000, 3000,
                                         chunk_rows=chunk_rows)
        told = {r.seq: (r.allowed, r.remaining) for r in found.collect()}
        assert told == {0: (True, 2), 1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 1), 5: (True, 2)}


def test_idle_keys_are_dropped(spark, tmp_path):
    schema = "seq long, key string, event_time timestamp"
    for rows in ([(0, "a", 0), (1, "b", 5)], [(2, "b", 9000)]):
        spark.createDataFrame(rows, "seq long, key string, ms long").select("seq", "key", F.timestamp_millis("ms").alias("event_time")).write.mode(
            "append").parquet(str(tmp_path / "in"))
        limits.store_rate_limits(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), 3, 1000, 3000, late_ms=1000)
    assert [r.key for r in spark.read.parquet(str(tmp_path / "out/state/batch=1")).collect()] == ["b"]


def similar_rule(points, threshold, memory):
    """One page after another: the newest kept pages of its title, and every structure kept."""
    ring, shapes, out = {}, set(), {}
    for seq, title, links, forms, length in points:
        def near(k, links=links, forms=forms, length=length):
            longest = max(k[2], length)
            ratio = 1.0 - min(abs(k[2] - length) / longest, 1.0) if longest else 1.0
            return 0.4 + (1.0 - min(abs(k[0] - links) + abs(k[1] - forms), 20) / 20.0) * 0.3 + ratio * 0.3 >= threshold
        if (title, links, forms) in shapes:
            out[seq] = "structure"
        elif any(map(near, ring.get(title, []))):
            out[seq] = "similar"
        else:
            out[seq] = "kept"
            ring[title] = [*ring.get(title, []), (links, forms, length)][-memory:]
            shapes.add((title, links, forms))
    return out


@pytest.mark.parametrize("memory, block", [(100, 7), (4, None)])
def test_similarity_of_a_busy_title(spark, tmp_path, memory, block):
    """One title with most pages, in blocks, with a memory that holds and one that overflows."""
    rng = random.Random(memory)
    points = [(i, "hot" if rng.random() < 0.7 else f"t{rng.randrange(3)}", rng.randrange(0, 90), rng.randrange(0, 4),
               rng.choice([0, 100, 190, 200, 400])) for i in range(300)]
    schema = "seq long, title string, links long, forms long, length long, site string"
    for part in (points[:200], points[200:230], points[230:]):
        spark.createDataFrame([(*p, "e.com") for p in part], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        found = similar.store_similarity(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), 0.85, memory, 2, block)
    want = similar_rule(points, 0.85, memory)
    assert len([s for s in want.values() if s == "kept"]) > 8
    assert {r.seq: r.decision for r in found.collect()} == want
