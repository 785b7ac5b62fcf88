import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from turnloom.operators import reuse
from turnloom.operators.reuse import reply_reuse, similar_reply
from turnloom.operators.usage import BUCKETS_PER_SPAN, FAN, LEVELS, rate_limit, usage_rollup
from turnloom.streaming.limits import rate_limit_stream, usage_rollup_stream
from turnloom.streaming.reuse import reply_reuse_stream

START = datetime(2024, 1, 1)


def calls(seed, keys, n, spread_ms):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, START + timedelta(milliseconds=rng.randrange(spread_ms))) for i in range(n)]
    return rows + [("edge", 10_000 + i, START + timedelta(milliseconds=ms)) for i, ms in enumerate((0, 60_000, 60_001, 120_001, 120_002))]


def expected(rows, limit, window):
    state, out = {}, {}
    for key, cid, at in sorted(rows, key=lambda r: (r[2], r[1])):
        ms = int((at - START).total_seconds() * 1000 + 0.5)
        count, start = state.get(key, (0, None))
        if start is None or ms - start > window:
            count, start = 0, ms
        out[cid] = (START + timedelta(milliseconds=start), count < limit)
        state[key] = (count + (count < limit), start)
    return out


@pytest.mark.parametrize("spread_ms,n,limit,window", [(400_000, 600, 3, 5_000), (20_000_000, 500, 2, 60_000), (9_000, 800, 4, 50)])
def test_rate_limit_matches_a_sequential_run(spark, spread_ms, n, limit, window):
    rows = calls(1, ["hot", "hot", "hot", "a", "b"], n, spread_ms)
    df = spark.createDataFrame(rows, "key_id string, call_id long, called_at timestamp").repartition(5)
    got = {r.call_id: (r.window_start, r.allowed) for r in rate_limit(df, limit, window).collect()}
    assert got == expected(rows, limit, window)


def test_rate_limit_carries_windows_through_every_level(spark):
    window = 1  # buckets of 2 ms: spans of 128 ms, blocks of 8,192 and of 524,288 ms
    top = 2 * BUCKETS_PER_SPAN * FAN**LEVELS
    edge = top - round(START.timestamp() * 1000) % top  # the first edge of a block of the last level after START
    rng = random.Random(3)
    ms = {edge + i for i in range(-9_000, 9_000) if i % 5 != 3 or rng.random() < 0.9}
    ms |= {edge + top + i for i in range(-40, 40)} | {edge + 3 * top + 7, edge + 3 * top + 8, edge + 3 * top + 10}
    rows = [(k, 2 * m + j, START + timedelta(milliseconds=m)) for j, k in enumerate(("hot", "cold")) for m in sorted(ms) if j == 0 or m % 3]
    df = spark.createDataFrame(rows, "key_id string, call_id long, called_at timestamp").repartition(3)
    got = {r.call_id: (r.window_start, r.allowed) for r in rate_limit(df, 1, window).collect()}
    assert got == expected(rows, 1, window)


def test_rate_limit_without_keys_times_or_rows(spark):
    schema = "key_id string, call_id long, called_at timestamp"
    assert rate_limit(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, START), ("a", 2, None), ("a", 3, START), ("a", 3, START)]
    got = rate_limit(spark.createDataFrame(rows, schema), 1).collect()
    assert sorted((r.call_id, r.allowed) for r in got) == [(3, False), (3, True)]


def run_stream(spark, batches, schema, tmp_path, build):
    src = str(tmp_path / "in")
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if query is None:
            stream = spark.readStream.schema(schema).parquet(src)
            query = build(stream).writeStream.outputMode("append").format("memory").queryName(f"q{tmp_path.name.replace('-', '_')}")
            query = query.option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
    query.stop()
    return spark.table(f"q{tmp_path.name.replace('-', '_')}").collect()


def run_once_per_batch(spark, batches, schema, tmp_path, build):
    """For processing-time timeouts, which keep a running query busy: one restarted trigger per input."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sink = build(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").format("parquet")
        query = sink.option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        query.awaitTermination(60)
    return spark.read.parquet(out).collect()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = sorted(calls(2, ["x", "y"], 120, 300_000), key=lambda r: (r[2], r[1]))
    schema = "key_id string, call_id long, called_at timestamp"
    got = run_stream(spark, [rows[:40], rows[40:90], rows[90:]], schema, tmp_path, lambda s: rate_limit_stream(s, 3, 20_000))
    assert {r.call_id: (r.window_start, r.allowed) for r in got} == expected(rows, 3, 20_000)


def test_usage_rollup_stream_closes_the_same_windows(spark, tmp_path):
    rows = [(f"k{i % 2}", START + timedelta(minutes=7 * i), i) for i in range(60)]
    schema = "key_id string, called_at timestamp, tokens_saved int"
    late = [("k0", START + timedelta(days=9), 0)]
    got = run_stream(spark, [rows[:30], rows[30:], late, late], schema, tmp_path, lambda s: usage_rollup_stream(s, "4 hours", "1 hour", "10 minutes"))
    batch = usage_rollup(spark.createDataFrame(rows, schema), "4 hours", "1 hour").collect()
    assert sorted(got) == sorted(batch)


def vectors(seed, n, scopes=("general::a", "general::b")):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(n):
        v = centres[rng.integers(4)] + 0.15 * rng.normal(size=8)
        v = v / np.linalg.norm(v)
        rows.append((i, scopes[int(rng.integers(len(scopes)))], i * 1000, v.tolist(), int(rng.integers(30, 90)), bool(rng.integers(5))))
    return rows


SCHEMA = "query_id long, scope string, at long, embedding array<double>, reply_chars long, storable boolean"


@pytest.mark.parametrize("block", [1000, 7])
def test_similar_reply_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(reuse, "BLOCK_ROWS", block)  # spheres of seven vectors rule out many pairs of blocks
    rows = vectors(3, 120)
    got = {r.query_id: (r.hit, r.match_id) for r in similar_reply(spark.createDataFrame(rows, SCHEMA), 0.92, 30_000).collect()}
    for q in rows:
        earlier = [e for e in rows if e[1] == q[1] and e[0] < q[0] and q[2] - e[2] <= 30_000]
        best = max(earlier, key=lambda e: (np.dot(e[3], q[3]), -e[0]), default=None)
        hit = best is not None and np.dot(best[3], q[3]) >= 0.92
        assert got[q[0]] == (hit, best[0] if hit else None)


def test_similar_reply_sees_all_of_a_busy_span(spark):
    rng = np.random.default_rng(4)
    rows = [(0, "s", 10, [1.0] + [0.0] * 7, 50, True)]
    for i in range(1, 2400):
        v = rng.normal(size=8)
        v[0] = 0
        rows.append((i, "s", 10 + i % 5, (v / np.linalg.norm(v)).tolist(), 50, True))
    rows.append((9000, "s", 20, [1.0] + [0.0] * 7, 50, True))
    got = {r.query_id: r.match_id for r in similar_reply(spark.createDataFrame(rows, SCHEMA), 0.999).collect()}
    assert len(got) == len(rows) and got[9000] == 0


def test_similar_reply_limits(spark):
    def unit(c):
        return [c, float(np.sqrt(1 - c * c))]

    rows = [(0, "s", 0, [1.0, 0.0], 50, True), (1, "s", 3_600_000, unit(0.9200001), 50, True), (2, "t", 0, [1.0, 0.0], 50, True),
            (3, "t", 3_600_001, [1.0, 0.0], 50, True), (4, "u", 0, [1.0, 0.0], 50, True), (5, "u", 1, unit(0.9199), 50, True)]
    got = {r.query_id: r.hit for r in similar_reply(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False}


def test_reuse_feeds_back(spark):
    v = [1.0, 0.0]
    rows = [(0, "s", 0, v, 49, True), (1, "s", 1, v, 50, True), (2, "s", 50, v, 60, True), (3, "s", 145, v, 60, True),
            (4, "s", 300, v, 60, True), (5, "s", 310, v, 60, False)]
    got = {r.query_id: (r.hit, r.match_id) for r in reply_reuse(spark.createDataFrame(rows, SCHEMA), ttl_ms=100).collect()}
    # 0 is too short to store; 2 prolongs entry 1 so that 3 still finds it; 4 comes after it expired
    assert got == {0: (False, None), 1: (False, None), 2: (True, 1), 3: (True, 1), 4: (False, None), 5: (True, 4)}


def test_reuse_stream_equals_batch(spark, tmp_path):
    rows = vectors(5, 90)
    batch = reply_reuse(spark.createDataFrame(rows, SCHEMA), capacity=9).collect()
    wide = [(*r, False) for r in rows]
    got = run_once_per_batch(
        spark, [wide[:30], wide[30:55], wide[55:]], SCHEMA + ", clear boolean", tmp_path, lambda s: reply_reuse_stream(s, capacity=9)
    )
    by_id = lambda rows: sorted(((r.query_id, r.scope, r.hit, r.match_id, r.saved_tokens) for r in rows))
    assert by_id(got) == by_id(batch)


def test_starts_of_many_spans_at_once_are_those_of_a_walk():
    """All spans of a table in one go: sparse ones, chains of adjacent buckets, and spans that a window is carried into."""
    import numpy as np

    from turnloom.operators.usage import BUCKETS_PER_SPAN, NONE, _starts

    rng, period = random.Random(4), 10
    spans, buckets, offsets, entries, expected = [], [], [], [], []
    for span in range(200):
        first = rng.randrange(5) * BUCKETS_PER_SPAN
        entry = rng.choice([NONE, rng.randrange(period)])
        start = first * period - period + entry if entry != NONE else None
        for at in sorted(rng.sample(range(30 * rng.choice([1, 8])), rng.randint(1, 12))):
            ms = first * period + at
            if start is None or ms - start >= period:
                start = ms
            spans.append(span)
            buckets.append(ms // period)
            offsets.append(ms % period)
            entries.append(entry)
            expected.append(start)
    got = _starts(*map(np.array, (spans, buckets, offsets, entries)), period)
    assert got.tolist() == expected
