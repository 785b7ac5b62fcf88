"""The prefix trie against a plain dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from turnloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, below = defaultdict(int), defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        leaves = sum(children[x] == 0 for x in below[p])
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[p] if x)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, longest, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 1000), convs):
        n = rng.choice([1, 2, 3, 5, 8, longest])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "tool", None]) if t % 3 else "user", rng.choice(["", None, "ab", "é" * 7, "x" * 50][:kinds])))
    return rows


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(df, **kw).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("cells", [1, 40 * prefix_trie.WIDTH, 1 << 20])
def test_all_nodes(spark, cells):
    rows = made(1, 150, 70, 2) + [(c, t, "user", "same") for c in (700, 701, 702, 703, 755) for t in range(75)]
    assert trie(spark, rows, cells=cells) == brute(rows)


def test_long_copies_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    rows = [(c, t, "user", "t%d" % (t if t < 150 or c % 3 else t * c)) for c in range(0, 12) for t in range(200 - c % 4)]
    assert trie(spark, rows, cells=3 * prefix_trie.WIDTH) == brute(rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "hello" if t < 2 else f"{c % 5}") for c in range(300) for t in range(c % 7)]
    assert trie(spark, rows, cells=16 * prefix_trie.WIDTH) == brute(rows)


def test_nulls_ties_and_missing_firsts(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, -3, "a", "late"), (205, 1, "user", ""), (205, 1, "user", "")]
    rows += [(c, t, "user", "q") for c in (301, 302, 303, -7, -107, 1 << 40) for t in range(2)]
    rows += [(9, 0, "user", "word " * 100_000)]
    assert trie(spark, rows) == brute(rows)


def test_turns_of_one_number_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in ("a", "b", "c", "d")]
    assert trie(spark, rows) == trie(spark, rows[::-1])


def test_empty(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
