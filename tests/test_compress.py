import pytest
from conftest import turns_of
from pyspark.sql import functions as F

from turnloom.operators.compress import (
    ALL_KEPT, ALL_PROTECTED, NO_MODEL, compress, compress_with_summary, fallback_rate, memory_frames, model_summary_input, placed_rows, requests,
    segment_heads, turn_rows,
)
from turnloom.operators.classify import classify
from turnloom.operators.hard_facts import hard_facts, hard_facts_of

CODING = [
    "hey", "Hey, what are you working on?", "nice weather today, random thought about a movie", "Sounds good.",
    "Help me with the Stripe webhook in TypeScript.", "Verify the signature on every request.",
    "Here is the error: 401 Unauthorized from /api/hooks/stripe on March 5", "Check the secret.",
    "I rotated the signing secret, ticket ABC-12345, it costs $1,200", "Did it help?",
    "The webhook throws a 401 on every third request. Why is it failing?",
]
SUPPORT = [
    "My order #A4821 never arrived", "Sorry about that.", "The tracking says delivered to Dallas", "We will look into it.",
    "I already called", "It was escalated for a refund by Hunt Construction", "Group on Friday", "ok", "refund now please",
]
MEDICAL = ["my blood pressure is 140/90", "How long?", "three weeks", "I see", "also a cough", "Mention it", "ask the doctor?"]
SMALL = ["aa", "bb", "cc", "dd", "ee"]
REPEATED = ["same words here again"] * 9


@pytest.fixture(scope="module")
def turns(spark):
    return turns_of(spark, [CODING, SUPPORT, MEDICAL, SMALL, CODING[-4:], REPEATED])


@pytest.fixture(scope="module")
def result(turns):
    c = compress(turns)
    summary = {r.conv_id: r for r in c.summary.collect()}
    texts = {}
    for r in sorted(c.turns.collect(), key=lambda r: (r.conv_id, r.out_pos)):
        texts.setdefault(r.conv_id, []).append(r)
    return summary, texts


def test_kept_whole(result):
    summary, texts = result
    assert summary[4].kept_reasons == [ALL_KEPT] and len(texts[4]) == 4
    assert summary[2].protected and summary[2].kept_reasons == [ALL_PROTECTED]
    assert [r.text for r in texts[2]] == MEDICAL and summary[2].tokens_saved == 0


def test_coding_memory_frame(result):
    s = result[0][0]
    assert (s.domain, s.intent) == ("coding", "debugging")
    assert s.user_goal.startswith("Resolve The webhook throws a 401")
    # six entities: five facts with digits or paths rank before the shortest known word
    assert len(s.entities) == 6 and s.entities[-1].lower() == "stripe" and "401" in s.unresolved


def test_invariants(result, turns):
    summary, texts = result
    original = {(r.conv_id, r.text) for r in turns.collect()}
    for cid, s in summary.items():
        assert s.tokens_saved >= 0 and s.n_compressed == len(texts[cid])
        total = sum(len(r.text) for r in texts[cid])
        assert s.compressed_tokens == -(-total // 4)
        body = [r for r in texts[cid] if r.pos >= 0]
        assert all((cid, r.text) in original for r in body)
        assert len({(r.role, r.text) for r in texts[cid]}) == len(texts[cid]) or s.n_compressed == s.n
        heads = [r for r in texts[cid] if r.pos < 0]
        assert len(heads) <= 1 and (not heads or heads[0].out_pos == 0)


def test_hard_facts_survive(result):
    summary, texts = result
    joined = " ".join(r.text for r in texts[0]).lower()
    assert "abc-12345" in joined and "$1,200" in joined and summary[0].kept_reasons[0].startswith("Turns brought back")


def test_long_path_equals_short_path(turns):
    for protect in (True, False):
        a, b = compress(turns, protect=protect), compress(turns, protect=protect, size=3)
        assert sorted(a.summary.collect()) == sorted(b.summary.collect())
        assert sorted(a.turns.collect()) == sorted(b.turns.collect())
    assert sorted(memory_frames(turns).collect()) == sorted(memory_frames(turns, size=2).collect())


def test_hard_facts_across_turns_match_the_joined_text(spark):
    conversations = [
        SUPPORT, CODING, ["Call 555 123", "4567 89 now"], ["due May", "5, 2024 ok"], ["Anna", "Bell", "Of", "of", "Carl Dean"],
        ["pays $5", "million", "10", "ms flat"], ["", "Big", " ", "Cat Dog Elk Fox Gnu", "Hen"], ["short Bay City", "Bay City Hall here"],
    ]
    turns = turns_of(spark, conversations)
    heads = turns.groupBy("conv_id").agg(F.max("turn").alias("current_turn")).withColumn("domain", F.lit("education"))
    expected = {}
    joined = spark.createDataFrame([(i, " ".join(c), "education") for i, c in enumerate(conversations)], "conv_id long, t string, d string")
    for r in joined.select("conv_id", hard_facts_of("t", "d").alias("f")).collect():
        if r.f:
            expected[r.conv_id] = r.f
    for size in (512, 2, 1):
        rows = placed_rows(turn_rows(turns, size), segment_heads(turns, heads, size))
        assert {r.conv_id: r.hard_facts for r in hard_facts(rows).collect()} == expected
    assert expected[1][0] == "March 5" and "Bay City Bay City" in expected[7]


def test_hard_facts_of_long_runs(spark):
    """Java's stack must not grow with the names in a row, nor with the digits and blanks at a text's end."""
    names = " ".join(["De"] * 20000)
    tail = "1" + " 2" * 20000
    texts = [f"{names} was here", f"{names} wash. Anna Bell was in", f"x {tail}", f"{tail} x", "Ed\u00a0Fox  is, Gnu HEn was"]
    rows = spark.createDataFrame([(i, 0, 0, t, "education") for i, t in enumerate(texts)], "conv_id long, seg long, pos long, text string, domain string")
    got = {r.conv_id: r.hard_facts for r in hard_facts(rows).collect()}
    four = "De De De De"
    assert got[0] == [four, names] and got[1] == [four, "Anna Bell"] and got[4] == ["Ed\u00a0Fox"]
    assert got[2] and got[2] == got[3]
    of = rows.select("conv_id", hard_facts_of("text", "domain").alias("f")).collect()
    assert {r.conv_id: r.f for r in of} == got


def test_model_summary_and_fallback(spark, turns):
    frames = classify(turns)
    summaries = spark.createDataFrame([(0, "Webhook work."), (3, None)], "conv_id long, summary string")
    c = compress_with_summary(turns, frames, summaries)
    rows = {r.conv_id: r for r in c.summary.collect()}
    assert rows[0].method == "model" and rows[3].method == "rule" and rows[4].method == "whole"
    assert rows[3].kept_reasons[0] == NO_MODEL
    head = c.turns.filter("conv_id = 0 AND out_pos = 0").first().text
    assert head.startswith("[CTX Memory] Webhook work. [Key facts: March 5")
    rate = fallback_rate(c.summary).first()
    assert (rate.requests, rate.successes, rate.fallbacks) == (5, 1, 4)
    given = {r.conv_id: r.model_input for r in model_summary_input(turns, frames).collect()}
    assert given[3] == "summarize: DOMAIN:general User: aa Assistant: bb User: cc Assistant: dd User: ee"
    assert "weather" not in given[0]


def test_requests_hold_the_current_text(turns):
    rows = {r.conv_id: r for r in requests(turns, classify(turns)).collect()}
    assert rows[0].latest_text == CODING[-1] and rows[0].n == len(CODING)
    assert rows[0].original_chars == sum(map(len, CODING))
