"""Suffix removal, near duplicates, language model and decontamination against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import common, decontaminate, hmm, near_copies, simhash, suffixes
from turnloom.llm.components import components

SCHEMA = "doc_id long, text string, spans int, fp int"


def made_texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    texts = [None, "", " ", "a", "x" * 49, "x" * 50, "x" * 400, "x" * 50 + "y", "ab" * 300]
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        at = rng.randint(0, len(text))
        texts.append(text[:at] + rng.choice([*passage, "", ""]) + text[at:] + rng.choice(["", "\n", " " * 60]))
    return texts + texts[12:20] + [texts[20][3:], texts[21][:-5] + "zz"]


def brute_removed(rows):
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            least[s] = min(least.get(s, 1 << 62), i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        yield i, (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("block", [1, 3000, 1 << 20])
def test_suffix_removal(spark, block):
    texts = made_texts()
    rows = [(i * 7919 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in suffixes.cut_repeats(docs, block_bytes=block).collect()}
    want = dict(brute_removed(rows))
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 3000
    for i, r in got.items():
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[i]


def test_suffix_edges(spark):
    rows = [(None, "q" * 80), (5, "q" * 70), (5, "q" * 70), (6, "q" * 60), (None, "r" * 70), (None, "r" * 70)]
    got = suffixes.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 70, 0), (0, 70, 0), (0, 80, 80), (5, 70, 0), (5, 70, 0), (6, 60, 60)]
    assert suffixes.repeats_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates(spark):
    texts = made_texts(4) + ["One two THREE", "one  two three", "A B", "a b", "a"]
    rng = random.Random(9)
    base = " ".join(f"w{rng.randint(0, 99)}" for _ in range(3000)).split()
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(3000)] = f"n{rng.randint(0, 9999)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    of = brute_components(set(prints))
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(of[p], i)
    assert [got[i].component_id for i in range(len(texts))] == [least[of[p]] for p in prints]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_long_lists_give_the_same_components(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(3):
        p = rng.getrandbits(64)
        for _ in range(140):
            p ^= 1 << rng.choice([*range(12), 63, 40])
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash.links(frame)
    assert links.filter("bit_count(a ^ b) > 2").count() == 0
    got = {r.node % (1 << 64): r.least for r in components(links).collect()}
    of = brute_components(prints)
    groups = Counter(of.values())
    assert max(groups.values()) > simhash.LONG
    for p in prints:
        assert (p in got) == (groups[of[p]] > 1)
    for a in got:
        assert all((got[a] == got[b]) == (of[a] == of[b]) for b in got)


def test_near_duplicates_edges(spark):
    rows = [(None, None), (None, ""), (3, " "), (3, " "), (None, "a b c d"), (None, "a b c d"), (None, "p q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.fingerprint == "0" * 16, r.component_id or 0) for r in got) == [(False, 0)] * 3 + [(True, 3)] * 4
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(docs).collect()) == [(0, "a b c d"), (0, "p q r s"), (3, " ")]
    assert simhash.keep_first(docs.limit(0)).count() == 0


def brute_copies(texts):
    """The least place of a near copy of each text, by five-word sets and all pairs."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            shared = len(sets[i] & sets[j])
            if shared * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(21)
    line = " ".join(f"c{i}" for i in range(12))
    texts = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d f", "a b c d e f g h i j", "a b c d e f g h i k"]
    for _ in range(40):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [f"n{rng.randint(0, 9)}"]
            texts.append(" ".join(copy) + (" " + line if rng.random() < 0.5 else ""))
    big = [f"b{i}" for i in range(150)]
    for _ in range(120):
        copy = list(big)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            copy[at] = f"n{rng.randint(0, 9999)}"
        texts.append(" ".join(copy))
    texts += texts[20:30]
    want = brute_copies(texts)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {}
    for r in near_copies.near_copies(docs).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, []).append(i)
    assert sorted(sorted(g) for g in got.values()) == sorted(groups.values())
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    assert near_copies.keep_one(docs.limit(0)).count() == 0
    assert len(groups) < simhash.keep_first(docs).count()


def brute_words(shingles):
    """The majority bits of a set of unsigned hashes, word by word."""
    mask = (1 << 64) - 1
    words = []
    for w in range(4):
        mixed = []
        for h in shingles:
            x = (h + w * 0x9E3779B97F4A7C15) & mask
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
            mixed.append(x ^ (x >> 31) if w else h)
        words.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return words


def test_fingerprints_propose_near_copies(spark):
    rng = random.Random(5)
    groups = []
    for size in [4] * 25 + [1] * 60 + [90]:
        base = [rng.getrandbits(64) for _ in range(rng.choice([60, 150]))]
        groups.append([{*base[rng.randint(1, 3) :], *(rng.getrandbits(64) for _ in range(rng.randint(0, 1)))} for _ in range(size)])
    sets = [set(), {7}, *(s for g in groups for s in g), {rng.getrandbits(64) for _ in range(near_copies.RUN + 5)}]
    rows = [(i, [h - (1 << 64) if h >> 63 else h for h in s]) for i, s in enumerate(sets)]
    given = spark.createDataFrame([*rows, (-1, None)], "node long, s array<long>").repartition(3)
    nodes = given.select("node", F.greatest(F.size("s"), F.lit(0)).alias("n"), F.arrow_udf(near_copies.fingerprint, "array<long>")("s").alias("print"))
    prints = {r.node: b"".join((w % (1 << 64)).to_bytes(8, "little") for w in r.print) for r in nodes.collect()}
    for i, s in enumerate(sets):
        assert prints[i] == b"".join(w.to_bytes(8, "little") for w in brute_words(s))
    assert prints[-1] == bytes(32)
    pairs = [(r.a, r.b) for r in near_copies.alike(nodes.filter("node > 0")).collect()]
    assert len(pairs) == len(set(pairs))
    for a, b in pairs:
        same = [x == y for x, y in zip(prints[a], prints[b], strict=True)]
        assert a < b and sum(same) >= near_copies.LEAST_BYTES and any(all(same[p] for p in key) for key in near_copies.KEYS)
    of = {r.node: r.least for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    at = 2
    for g in groups:
        names = {of.get(i, i) for i in range(at, at + len(g))}
        assert names == {at}
        at += len(g)


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Without the second look, which lists shingles, the fingerprints alone connect copies with few edits."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base[:90], "new", *base[91:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_pairs", lambda matched: matched.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == list(range(0, 36, 3))


def test_no_join_of_near_copies_is_broadcast_by_an_estimate(spark, monkeypatch):
    """The size of exploded fingerprints is estimated without the explode, so plans made before any job must not trust it."""
    thresholds = {name: spark.conf.get(name, None) for name in (common.ESTIMATED, common.MEASURED)}
    plans = []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.stored(df, name)

    monkeypatch.setattr(near_copies, "stored", recorded)
    monkeypatch.setattr(near_copies, "HELD", -1)  # what is counted before it is broadcast is not asked about here
    monkeypatch.setattr("turnloom.llm.components.stored", recorded)
    texts = [" ".join(f"w{j}" for j in range(60 * (i // 3), 60 * (i // 3) + 60 - i % 3)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.near_copies(docs)
    assert found.select("root").distinct().count() == 10
    assert {"near-byte-lists", "near-pairs", "links"} <= {name for name, _ in plans}
    planned = [*plans, ("result", found._jdf.queryExecution().executedPlan().toString())]
    assert [name for name, plan in planned if "Broadcast" in plan] == []
    assert {name: spark.conf.get(name, None) for name in thresholds} == thresholds


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.least for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def brute_base(rows):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
    learned = {i for i, (key, _) in enumerate(rows) if zlib.crc32(b"" if key is None else str(key).encode()) % 7 != 2}
    counts = Counter(w for i in learned for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        yield len(own), sum(counts[w] > 0 for w in own), n, i not in learned, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)


def test_language_model_base(spark):
    rows = list(enumerate(made_texts(5, 120))) + [(None, "a b"), (None, None), (3, "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in hmm.score_texts(docs).collect())
    assert got == sorted((a, b, c, d, round(e, 6)) for a, b, c, d, e in brute_base(rows))


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out, row.base_score) == (3, 0, 0, True, 0.0)
    assert hmm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_model_does_not_depend_on_the_layout(spark):
    texts = made_texts(n=700)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    some, many = (hmm.score_texts(plain.repartition(n, "text")).collect() for n in (2, 7))

    def ordered(got):
        return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in got), key=lambda r: (*r[:3], round(r[3], 3)))

    for a, b in zip(ordered(some), ordered(many), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-4, abs_tol=1e-4)
    drawn = sorted(hmm.place_of(i) for i, _ in rows if hmm.remainder_of(i, 7) != 2)[: hmm.WARM]
    assert len(drawn) == hmm.WARM and drawn[0] < drawn[-1]


def naive_forward(model, codes):
    alpha = model.start * model.emit[codes[0]]
    for c in codes[1:]:
        alpha = (alpha @ model.move) * model.emit[c]
    return math.log(alpha.sum())


def small_model(states=3, classes=11, seed=2):
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.ones(classes), states).T
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit)


def test_forward_is_exact_and_rounds_never_lose_likelihood():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 40, 50)
    codes = rng.integers(0, 11, lengths.sum()).astype(np.uint16)
    starts = np.cumsum(lengths) - lengths
    model = small_model()
    scores = hmm.forward(model, codes, starts, lengths)
    assert np.allclose(scores, [naive_forward(model, codes[s : s + n]) for s, n in zip(starts, lengths, strict=True)])
    begin, moves, emits = hmm.expected(model, codes, starts, lengths, np.ones(50, bool))
    assert np.isclose(begin.sum(), 50) and np.isclose(moves.sum(), lengths.sum() - 50, rtol=1e-4) and np.isclose(emits.sum(), lengths.sum(), rtol=1e-4)
    better = hmm.Model(begin / begin.sum(), model.mean, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert hmm.forward(better, codes, starts, lengths).sum() > scores.sum()


def test_model_sums_to_one():
    share = np.array([0.5, 0.3, 0.2])
    model = hmm.maximise(np.array([1.0, 0]), np.array([[3.0, 1], [0, 0]]), np.array([[1.0, 0], [2, 2], [0, 0]]), share)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    total = sum(math.exp(naive_forward(model, [a, b])) for a in range(3) for b in range(3))
    assert math.isclose(total, 1)


def naive_align(a, b):
    best = 0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            step = decontaminate.MATCH if a[i] == b[j] and a[i] else decontaminate.MISMATCH
            table[i + 1][j + 1] = max(0, table[i][j] + step, table[i][j + 1] + decontaminate.GAP, table[i + 1][j] + decontaminate.GAP)
            best = max(best, table[i + 1][j + 1])
    return best


def test_alignment():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))) for _ in range(200)]
    best, _, _ = decontaminate.align([p[0] for p in pairs], [p[1] for p in pairs])
    assert best.tolist() == [naive_align(a.tolist(), b.tolist()) for a, b in pairs]


def test_decontamination(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    items = [" ".join(rng.choice(common) if rng.random() < 0.4 else f"v{rng.randint(0, 3000)}" for _ in range(35)) for _ in range(12)]
    docs, want = [], set()
    for d in range(300):
        words = rng.choices(common + [f"z{i}" for i in range(500)], k=80)
        if d % 5 == 0:
            item = rng.randrange(12)
            own = [w if rng.random() > 0.15 else "edited" for w in items[item].split()]
            del own[rng.randrange(35)]
            words[40:40] = [w.upper() + "," for w in own]
            want.add((d, item))
        docs.append((d, " ".join(words), 1, 2))
    docs += [(900 + i, items[3], 1, 2) for i in range(60)] + [(None, items[4], 1, 2), (None, None, 1, 2), (901, "", 1, 2)]
    want |= {(900 + i, 3) for i in range(60)} | {(None, 4)}
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, ""), (79, "c1"), (None, None)], "item_id long, text string")
    found = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 and decontaminate.contaminated(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("copies", [1, 2000])
def test_decontamination_of_copies_with_broken_grams(spark, copies):
    rng = random.Random(12)
    items = [[f"v{rng.randint(0, 3000)}" for _ in range(40)] for _ in range(3)]
    passages = [
        [w if i % 4 else "edited" for i, w in enumerate(items[0])],
        [w if i % 5 else "edited" for i, w in enumerate(items[1])],
        items[2][:20],
    ]
    docs, want = [], set()
    for n in range(copies):
        for at, passage in enumerate(passages):
            around = [f"z{rng.randint(0, 500)}" for _ in range(30)]
            docs.append((len(docs), " ".join(around[:15] + passage + around[15:])))
            want.add((len(docs) - 1, at))
    # one n-gram of an item is no copy
    docs += [(10_000 + n, " ".join([f"z{rng.randint(0, 500)}" for _ in range(50)] + items[n % 3][30:33])) for n in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def test_items_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma delta{i}") for i in range(50)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, most_words=60))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(50))
