"""Ranking through the stored index against scoring all pages, with and without hot terms."""

import random
import re

import pytest

from turnloom.operators.recall import ingest_prompt, rank_pages, recall, related_pages, write_index

SECTIONS = "owner string, path string, title string, seq long, ord int, source_id string, added_at timestamp, tags array<string>, markdown string"
TOKEN = re.compile(r"\b[a-z][a-z0-9-]{3,}\b", re.ASCII)
WORDS = ["stripe", "webhook", "signature", "invoice", "error", "errors", "timeouts", "deploying", "deploy", "travel", "hotel", "the-hotel", "overview", "codes", "abc", "ünder"]


def made(seed, pages=60, queries=25):
    import datetime

    rng = random.Random(seed)
    rows, at = [], datetime.datetime(2026, 1, 1)
    for p in range(pages):
        owner = rng.choice(["ann", "bob"])
        for s in range(rng.randint(1, 3)):
            text = " ".join(rng.choices(WORDS, k=rng.randint(0, 12)) + (["common"] if p % 9 else []))
            rows.append((owner, f"notes/p{p}.md", f"{rng.choice(WORDS)} {p}", p * 10 + s, s, f"src{p}-{s}", at + datetime.timedelta(hours=rng.randint(0, 5)), [rng.choice(["Overview", "billing", "Code"])], text))
    asked = [(i, rng.choice(["ann", "bob", "eve"]), " ".join(rng.choices([*WORDS, "common", "billing", "commonly"], k=rng.randint(0, 6)))) for i in range(queries)]
    return rows, asked + [(900, "ann", "common"), (901, "bob", "common"), (902, "ann", ""), (903, "ann", "common overview stripe")]


def pages_of(rows):
    out = {}
    for owner, path, title, seq, ord_, _, at, tags, text in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4])):
        p = out.setdefault((owner, path), {"tags": [], "text": [], "first": (seq, ord_)})
        p["title"], p["at"] = title, max(at, p.get("at", at))
        p["tags"] += [t for t in tags if t not in p["tags"]]
        p["text"].append(text)
    return out


def brute(rows, asked, kind, k):
    pages, out = pages_of(rows), {}
    for q, owner, text in asked:
        low, scored = text.lower(), []
        for (o, path), p in pages.items():
            if owner is not None and o != owner:
                continue
            tags = sum(t.lower() in low for t in p["tags"])
            if kind == "recall":
                hay = " ".join([o, path, p["title"], *p["tags"], "\n".join(p["text"])]).lower()
                score = sum(t in hay for t in set(TOKEN.findall(low))) + 3 * tags
                order = (-score, -p["at"].timestamp(), o, path)
            elif kind == "rank":
                body = sum(t in low for x in p["text"] for t in TOKEN.findall(x.lower()))
                score = tags + sum(t in low for t in TOKEN.findall(p["title"].lower())) + min(5, body)
                order = (-score, -p["at"].timestamp(), p["first"])
            else:
                hay = "\n".join(p["text"]).lower()
                score = sum(t in hay for t in TOKEN.findall(f"{low} fresh"))
                order = (-score, p["first"])
            if score or kind != "recall":
                scored.append((order, o, path, score))
        out |= {(q, i + 1): x[1:] for i, x in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("hot", [4096, 6, 0])
def test_ranking_equals_that_of_all_pages(spark, hot):
    rows, asked = made(hot + 1)
    index = write_index(spark.createDataFrame(rows, SECTIONS).repartition(3), hot=hot)
    queries = spark.createDataFrame([(*a,) for a in asked], "query_id long, owner string, text string")
    everywhere = [(q, None if q % 2 else o, t) for q, o, t in asked]
    got = recall(spark.createDataFrame(everywhere, "query_id long, owner string, text string"), index).collect()
    assert {(r.query_id, r["rank"]): (r.owner, r.path, r.score) for r in got} == brute(rows, everywhere, "recall", 4)
    got = rank_pages(queries, index).collect()
    assert {(r.query_id, r["rank"]): (r.owner, r.path, r.score) for r in got} == brute(rows, asked, "rank", 4)
    sources = spark.createDataFrame([(o, q, "fresh", t) for q, o, t in asked], "owner string, source_id long, title string, content string")
    got = related_pages(sources, index).collect()
    assert {(r.source_id, r["rank"]): (r.owner, r.path, r.score) for r in got} == brute(rows, asked, "related", 3)


def test_a_hot_word_does_not_meet_every_query(spark):
    """A word of all pages is scored once for each set of hot words, not once for each query."""
    rows = [("ann", f"p{i}", "t", i, 0, f"s{i}", None, ["x"], "everywhere") for i in range(200)]
    index = write_index(spark.createDataFrame(rows, SECTIONS), hot=50)
    queries = spark.range(300).selectExpr("id as query_id", "'ann' as owner", "concat('everywhere ', id) as text")
    ranked = recall(queries, index)
    assert ranked.count() == 1200
    ranked.write.format("noop").mode("overwrite").save()
    made_rows = []

    def walk(plan):
        node = plan.nodeName()
        if "Join" in node and plan.metrics().contains("numOutputRows"):
            made_rows.append(plan.metrics().apply("numOutputRows").value())
        inner = plan.executedPlan() if node == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in node else None
        children = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
        for child in children:
            walk(child)

    done = ranked._jdf.queryExecution()
    ranked._jdf.queryExecution().executedPlan().executeCollect()
    walk(done.executedPlan())
    assert made_rows and max(made_rows) < 20_000  # 300 queries times 200 pages are 60,000


def test_empty_index_and_queries(spark):
    index = write_index(spark.createDataFrame([], SECTIONS))
    queries = spark.createDataFrame([(1, "ann", "stripe"), (2, None, None)], "query_id long, owner string, text string")
    assert recall(queries, index).count() == 0 and rank_pages(queries, index).count() == 0
    rows, _ = made(2, 5)
    index = write_index(spark.createDataFrame(rows, SECTIONS))
    assert recall(queries.filter("query_id = 2"), index).count() == 0
    source = spark.createDataFrame([("ann", "n", "", None, "d", "i", "s")], "owner string, source_id string, title string, content string, domain string, intent string, state string")
    assert ingest_prompt(source, index).count() == 1


def test_pairs_of_blocks_score_like_a_join(monkeypatch):
    """Products of two blocks, a few at a time, with the body capped; the best of equal scores are the earlier pages."""
    import numpy as np

    from turnloom.operators import recall as op

    monkeypatch.setattr(op, "AT_ONCE", 7)
    rng = random.Random(5)
    pages = [[(rng.randrange(20), rng.randint(1, 3)) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    asked = sorted((rng.randrange(20), rng.randrange(6), rng.randint(1, 2), rng.random() < 0.5) for _ in range(60))
    hits = [h for p in pages for h in p]
    cuts = np.append(0, np.cumsum([len(p) for p in pages]))
    page_hits = cuts, np.array([u for u, _ in hits]), np.array([n for _, n in hits])
    for most in (None, 5):
        got = op._pair_scores(page_hits, tuple(map(np.array, zip(*asked, strict=True))), 6, most)
        for i, page in enumerate(pages):
            for q in range(6):
                own, body = (sum(w * n for u, n in page for v, of, w, b in asked if v == u and of == q and b == kind) for kind in (False, True))
                assert got[i, q] == own + (body if most is None else min(most, body))
        best = sorted(zip(*(x.tolist() for x in op._best(got, 3)), strict=True), key=lambda x: x[1])
        for q in range(6):
            expected = sorted(((-got[i, q], i) for i in range(40) if got[i, q]))[:3]
            assert sorted((-got[i, q], i) for i, of in best if of == q) == expected


def test_blocks_of_few_pages_and_queries_lose_nothing(spark, monkeypatch):
    from turnloom.operators import recall as op

    monkeypatch.setattr(op, "PAGES_PER_BLOCK", 7)
    monkeypatch.setattr(op, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    rows, asked = made(11)
    index = write_index(spark.createDataFrame(rows, SECTIONS), hot=0)
    everywhere = [(q, None if q % 2 else o, t) for q, o, t in asked]
    got = recall(spark.createDataFrame(everywhere, "query_id long, owner string, text string"), index).collect()
    assert {(r.query_id, r["rank"]): (r.owner, r.path, r.score) for r in got} == brute(rows, everywhere, "recall", 4)
    got = rank_pages(spark.createDataFrame(asked, "query_id long, owner string, text string"), index).collect()
    assert {(r.query_id, r["rank"]): (r.owner, r.path, r.score) for r in got} == brute(rows, asked, "rank", 4)


def test_postings_are_written_without_a_row_for_each_word(spark):
    """A section is one row of the postings, however many words it has."""
    rows = [("ann", f"p{i % 3}", "t", i, 0, f"s{i}", None, ["x"], "under_score the-hotel webhook " * 50) for i in range(30)]
    index = write_index(spark.createDataFrame(rows, SECTIONS))
    assert index.postings.filter("part = 'text'").count() == 30
    queries = spark.createDataFrame([(1, "ann", "the-hotel hook score")], "query_id long, owner string, text string")
    assert {r.score for r in recall(queries, index).collect()} == {3}
