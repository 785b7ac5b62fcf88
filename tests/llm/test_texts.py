"""Token counts, BPE, quality rules, toxicity and the pipeline against the library, brute force and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from turnloom.llm import bpe, decontaminate, quality, token_counts, toxicity
from turnloom.llm.common import documents, remainder_of

SMALL = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, ids int"
ODD = [
    None, "", " ", "\n\n", "a", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "İstanbul ẞ Σας \x1f\x85  x  \n\n  y'll'sS'S 12½ ²",
    "é é 👍👍 日本語 ​", "x" * 5000, "ab " * 4000, "".join(map(chr, range(32, 0x250))), "it's WE'LL they'RE 'd'", "­soft\xa0hard", " ".join("ab" * 200_000),
]


def made(n=400):
    rng = random.Random(6)
    return ["".join(rng.choice("aé '\n\t1½_#.sSABd­\u0085\x0bß  ") for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + made()
    return spark.createDataFrame([*((i, t, 1, 2) for i, t in enumerate(texts)), (None, "a b", 1, 2), (3, "rep eated", 1, 2)], SCHEMA)


@pytest.mark.parametrize("parts", [1, 5])
def test_token_counts_equal_the_library(docs, parts):
    whole = Tokenizer.from_file(WORDS)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.token_counts(docs.repartition(parts), WORDS).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def test_bpe_equals_the_library(docs):
    whole = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = bpe.bpe_digest(docs, BYTES).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.bpe_digest(docs.limit(0), BYTES).count() == 0
    apart = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert Counter(map(tuple, apart.collect())) == Counter(map(tuple, bpe.round_trip(docs, BYTES).collect()))


def test_the_short_way_knows_its_characters():
    """Each usual character behaves in the short way as in the library, alone and beside letters, digits and spaces."""
    words, coder = token_counts.Pieces(WORDS), bpe.Coder(BYTES)
    whole = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for c in map(chr, range(0x260)):
        text = f"a{c}b 1{c}2 {c} {c}{c}A{c}\n{c}"
        special, found = words.count(text)
        assert special + sum(n * words.tokens(p) for p, n in found.items()) == len(whole[0].encode(text, add_special_tokens=False).ids), ord(c)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == whole[1].encode(text, add_special_tokens=False).ids, ord(c)


def test_forced_cuts_are_used():
    coder = bpe.Coder(BYTES)
    assert 0.9 < coder.forced.mean() < 1
    raw = ("zq" * 30 + "é").encode()
    cuts = coder.cuts(raw).tolist()
    assert len(cuts) > 20 and all(coder.forced[raw[i - 1], raw[i]] for i in cuts)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_quality_counts(spark, docs):
    rng = random.Random(2)
    texts = ODD + made(200) + [" ".join(rng.choices("abc", k=rng.randint(0, 300))) for _ in range(80)] + ["l\nl\n \nl m\nl m", "a b c d e f g h " * 3]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    trees = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    got = {r.doc_id: r for r in quality.judge(frame, trees).collect()}
    for i, text in enumerate(texts):
        counts = brute_counts(text)
        assert [got[i][c] for c in quality.COUNTS] == counts, text
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed)
    kept = quality.keep(frame, trees)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(frame.limit(0), trees).count() == 0 and quality.keep(frame.limit(0), trees).count() == 0


def test_trees_are_monotonic_and_right():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(6 * x[:, 0] - 4 * x[:, 1] * (x[:, 2] > 0.5) - 1))).astype(float)
    trees = quality.fit(x[:2000], y[:2000], np.array([-1, 0, 0]))
    p = trees.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.75
    grid = np.linspace(0, 1, 50)
    for row in x[:100]:
        line = np.repeat(row[None], 50, axis=0)
        line[:, 0] = grid
        assert (np.diff(trees.raw(line)) <= 1e-12).all()


def test_quality_on_held_out_labels(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), documents(spark, "/root/testdata/sf0.01", "labels")
    trees = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.judge(docs, trees).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    again = quality.train(docs.repartition(7), labels.filter("doc_id % 3 <> 0").repartition(5))
    assert np.array_equal(again.value, trees.value)
    assert quality.train(docs, labels.limit(0)).probability(np.zeros((1, len(quality.STATISTICS)))) > 0.5


def test_toxicity_on_held_out_labels(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), documents(spark, "/root/testdata/sf0.01", "labels")
    flipped = labels.selectExpr("doc_id", "quality", "toxic", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 as held")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    rows = [r for r in flipped.collect() if r.held]
    assert len(got) == docs.count() and all(got[r.doc_id].held_out for r in rows)
    right = [got[r.doc_id].predicted == r.toxic for r in rows]
    assert np.mean(right) > 0.9
    scores = {y: [got[r.doc_id].score for r in rows if r.toxic == y] for y in (0, 1)}
    assert np.mean([a > b for a in scores[1] for b in scores[0]]) > 0.6  # few labels here, whose words don't occur in the others
    blind = flipped.selectExpr("doc_id", "quality", "CASE WHEN held THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in toxicity.toxicity_digest(docs, blind).collect()} == {i: r.score for i, r in got.items()}
    assert all(remainder_of(i, 5) for r in got.values() for i in r.evidence)


def test_nearest_equal_brute_force():
    import pandas as pd

    rng = random.Random(3)
    texts, toxic = [], []
    for _ in range(400):
        y = rng.random() < 0.4
        texts.append(" ".join(rng.choices(["bad", "awful", "nasty"] if y else ["fine", "good", "nice"], k=rng.randint(0, 3)) + rng.choices([f"w{i}" for i in range(50)], k=20)))
        toxic.append(int(y))
    index = toxicity.learn(pd.DataFrame({"doc_id": range(400), "text": texts, "toxic": toxic}), (900, 160))
    assert index.number
    vectors = np.zeros((400, len(index.number)))
    for i, t in enumerate(texts):
        found = Counter({index.number[f]: n for f, n in toxicity.counted(t).items() if f in index.number})
        f, w = index.vector(found)
        vectors[i, f] = w
    for i in range(0, 400, 7):
        found = np.flatnonzero(vectors[i])
        if len(found):
            near, cosine = index.nearest(found, vectors[i, found])
            want = vectors @ vectors[i]
            order = np.lexsort((np.arange(400), -np.round(want, 12)))[: toxicity.NEAREST]
            order = order[want[order] > 0]
            assert near.tolist() == order.tolist() and np.allclose(cosine, want[order])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, 2), (None, "a", 1, 2), (1, "b", 1, 2), (2, "", 1, 2)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_digest(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity_digest(docs, labels.limit(0)).count() == 4


def test_pipeline(spark):
    docs = documents(spark, SMALL).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "benchmark passages", "personal data", "token ids"]
    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        assert now.count() <= before
        before = now.count()
    final = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in now.select("doc_id").collect()}
    text = {r.doc_id: r.text for r in now.collect()}
    coder = bpe.Coder(BYTES)
    for r in final:
        assert r.text == text[r.doc_id] and bytes(r.ids) == coder.encode(r.text) and r.n_tokens == len(r.ids) // 4
        assert "@mail" not in r.text
    found = decontaminate.contaminated(docs, documents(spark, SMALL, "benchmark")).select("doc_id").distinct().collect()
    assert found and not {r.doc_id for r in found} & set(text)
    original = {r.doc_id: r.text for r in docs.collect()}
    assert len({original[i] for i in text}) == len(text)
