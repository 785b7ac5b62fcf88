"""Hard negatives and nearest neighbours against all pairs."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import hard_negatives, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 7, "x") for i, v, c in rows], SCHEMA).repartition(3)


def made(seed, n, dims=12, groups=6):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = []
    for i in rng.sample(range(n * 4), n):
        center = rng.choice(centers)
        spread = rng.choice([0.0, 0.1, 1.0])
        rows.append((i, [np.float32(x + rng.gauss(0, spread)).item() for x in center], rng.randrange(4)))
    return rows


def fit_to_use(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every):
    kept = {}
    for i, v, c in rows:
        if i is None or c is None or not fit_to_use(v):
            continue
        c = (c + 1) % 10 if i % 7 == 0 else c
        w = [math.floor(Fraction(256) * Fraction(x)) for x in v]
        kept[i] = min(kept.get(i, (c, v, w)), (c, v, w))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (c, _, w) in kept.items():
        if a % every:
            continue
        scored = sorted((-dot(w, kept[i][2]), i, kept[i][0] == c) for i in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            found = [(n, i) for n, i, same in scored if not same and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(found)]
    return sorted(out)


def negatives(spark, rows, every=10, **kw):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, label, **kw)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("dims", "per_block"), [(12, 512), (64, 7), (1, 20)])
def test_negatives_are_those_of_all_pairs(spark, dims, per_block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    rows = made(dims, 300, dims)
    want = brute_negatives(rows, 10)
    assert len(want) > 20 and negatives(spark, rows, anchors_per_block=per_block) == want


def test_negatives_with_odd_rows(spark):
    rows = made(5, 120, 5) + [(0, [1.0] * 5, 1), (0, [0.5] * 5, 1), (0, [0.5] * 5, 2), (None, [1.0] * 5, 1), (700, None, 1), (710, [1.0, None], 1)]
    rows += [(720, [float("nan")] * 5, 1), (730, [float("inf")] * 5, 1), (740, [], 1), (750, [1.0, 2.0], 1), (760, [0.0] * 5, 1), (770, [1.0] * 5, None), (780, [-3.0] * 9, 2)]
    rows += [(800 + i, [0.25] * 5, i % 2) for i in range(60)]
    assert negatives(spark, rows) == brute_negatives(rows, 10)


def test_no_negatives_without_rows(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert negatives(spark, [(10, [1.0], 1)]) == []


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    table_ = np.round(rng.normal(0, 90, (40, 64)))
    finest = hard_negatives.summaries(table_)
    exact, width = table_ @ table_.T, None
    for s in hard_negatives.SEGMENTS:
        m, d = hard_negatives.coarser(*finest, s)
        assert (np.abs(exact - m @ m.T) <= d @ d.T + 1e-6).all()
        assert width is None or (d @ d.T).sum() < width
        width = (d @ d.T).sum()
        plain = table_.reshape(40, s, -1)
        assert np.allclose(m, plain.mean(axis=2) * math.sqrt(64 // s)) and np.allclose(d, plain.std(axis=2) * math.sqrt(64 // s))


def brute_nearest(rows, every, most=5):
    kept = {}
    for i, v, _ in rows:
        if i is not None and fit_to_use(v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            def cosine(w, v=v):
                return sum(x * y for x, y in zip(v, w, strict=False)) / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w)))
            out[q] = sorted((-round(cosine(w), 12), i) for i, w in kept.items() if i != q)[:most]
    return out


def nearest(spark, rows, every=10, **kw):
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") % every == 0, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("rows_per_block", [40, 8192])
def test_neighbours_reach_the_recall(spark, rows_per_block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 24).astype(np.float32).tolist(), 0) for i in range(1500)]
    want = brute_nearest(rows, 10)
    got = nearest(spark, rows, block_rows=rows_per_block)
    assert recall(got, want) >= 0.9
    true = {(q, i): s for q in want for s, i in brute_nearest([r for r in rows if r[0] == q or r[0] in {x for _, x in got[q]}], 1)[q]} if rows_per_block == 40 else {}
    assert all(abs(true[q, i] - s) < 1e-9 for q in got for s, i in got[q] if (q, i) in true)


def test_neighbours_in_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    center = rng.normal(0, 1, 16)
    rows = [(i, center.astype(np.float32).tolist(), 0) for i in range(0, 900, 2)]
    rows += [(i, (center + rng.normal(0, 0.05, 16)).astype(np.float32).tolist(), 0) for i in range(1, 900, 2)]
    rows += [(1000 + i, rng.normal(0, 1, 16).astype(np.float32).tolist(), 0) for i in range(300)]
    got, want = nearest(spark, rows, block_rows=64), brute_nearest(rows, 10)
    assert recall(got, want) >= 0.9
    exact = [q for q in want if q < 900 and q % 2 == 0]
    assert all([i for _, i in got[q]] == [i for _, i in want[q]] for q in exact)  # the same vector, by id


def test_neighbours_with_odd_rows(spark):
    rows = [(i, [float(i % 13 - 6), 1.0, float(i % 5)], 0) for i in range(60)]
    rows += [(None, [1.0] * 3, 1), (100, None, 1), (110, [1.0, None], 1), (120, [0.0] * 3, 1), (130, [], 1), (140, [float("nan")] * 3, 1)]
    rows += [(150, [2.0, 1.0], 1), (160, [1.0] * 5, 1), (170, [1e-30] * 3, 1), (180, [1e30] * 3, 1), (50, [9.0, 9.0, 9.0], 0)]
    got, want = nearest(spark, rows), brute_nearest(rows, 10)
    assert recall(got, want) >= 0.9 and set(got) == set(want)


def test_no_neighbours_without_rows(spark):
    assert nearest(spark, []) == {}
    assert nearest(spark, [(10, [1.0], 1)]) == {}
    assert nearest(spark, [(10, [1.0], 1), (11, [2.0], 1)]) == {10: [(-1.0, 11)]}
