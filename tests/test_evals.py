"""Plugin and memory evaluation, cross-session memory and whole requests on hand-made cases."""

from conftest import turns_of
from pyspark.sql import functions as F

from turnloom.operators.carry_over import carry_over, frame_sources
from turnloom.operators.compress import compress, compress_with_summary, fallback_rate, memory_frames, model_summary_input
from turnloom.operators.classify import classify, last_frames
from turnloom.operators.evals import memory_eval, pass_rate, plugin_eval
from turnloom.operators.handle import handle
from turnloom.operators.memory import merge_pages, page_sections, whole_pages
from turnloom.session import durable

PLUGINS = (
    {"id": "gardens", "label": "Gardens", "keywords": ["compost", "raised bed"], "behavior": "Name the season.", "constraints": "No pesticides."},
    {"id": "boats", "label": "Boats", "keywords": ["keel", "mooring"], "behavior": "Ask for the length.", "constraints": "No legal advice on ports."},
)
CASE = "id string, message string, history array<struct<role:string,content:string,timestamp:string>>, plugin_ids array<string>, expectedDomain string, contains array<string>, excludes array<string>"


def test_plugin_cases(spark):
    said = [("user", "my keel is bent", None)]
    cases = spark.createDataFrame(
        [
            ("hit", "how hot must compost get", [], ["gardens", "boats"], "gardens", ["name the season", "no pesticides"], ["length"]),
            ("history", "what now", said, ["gardens", "boats"], "boats", ["length"], ["season"]),
            ("first listed wins", "compost near the mooring", [], ["boats", "gardens"], "boats", [], []),
            ("two words", "a raised bed please", [], ["gardens"], "gardens", [], []),
            ("not offered", "how hot must compost get", [], ["boats"], "general", [], ["season"]),
            ("none", "hello there", [], [], "general", None, ["season"]),
        ],
        CASE,
    )
    results = plugin_eval(cases, PLUGINS)
    assert {r.id: r["pass"] for r in results.collect()} == {r.id: True for r in cases.collect()}
    assert pass_rate(results).first().asDict() == {"cases": 6, "passed": 6, "pass_rate": 1.0}


def test_memory_of_one_session_reaches_the_next(spark):
    first = turns_of(spark, [["The api throws error 403 in my webhook function", "Check the signature.", "I use Stripe and Redis", "Good.", "Still failing with 403 on the webhook"]])
    second = spark.createDataFrame([(0, "0", "the webhook signature again")], "query_id long, owner string, text string")
    context = carry_over(first, second).first().context
    assert "webhook" in context.lower()
    sections = durable(page_sections(durable(frame_sources(memory_frames(first)))))
    pages = whole_pages(sections)
    assert pages.count() == merge_pages(sections).count() and all(len(p.source_ids) == 1 for p in pages.collect())
    text = pages.agg(F.concat_ws("\n", F.collect_list("markdown")).alias("page_text")).withColumn("id", F.lit("a"))
    cases = spark.createDataFrame([("a", ["Webhook", "403"], ["webhook"]), ("b", ["x"], [])], "id string, expected_pages array<string>, expected_context array<string>")
    contexts = spark.createDataFrame([("a", context)], "id string, context string")
    assert {r.id: r["pass"] for r in memory_eval(cases, text, contexts).collect()} == {"a": True, "b": False}


def talks(spark):
    long_talk = ["The api throws an exception", "Where?", "In the parser, error 403", "ok", "still failing", "hm", "please fix the function"]
    return turns_of(spark, [long_talk, [*long_talk, "sure", "any news on the exception"], ["hello"]])


def test_whole_request(spark):
    turns = talks(spark)
    routed, done = handle(turns)
    frames = {r.conv_id: r for r in last_frames(classify(turns)).collect()}
    summary = {r.conv_id: r for r in compress(turns).summary.collect()}
    rows = {r.conv_id: r for r in routed.collect()}
    assert set(rows) == {0, 1, 2}
    for c, r in rows.items():
        assert (r.domain, r.intent, r.state) == (frames[c].domain, frames[c].intent, frames[c].state)
        assert r.compressed_tokens == summary[c].compressed_tokens and f"Intent: {r.intent}." in r.system_prompt
    assert done.turns.filter("conv_id = 2").count() == 1


def test_model_summaries_and_fallback(spark):
    turns = talks(spark)
    frames = classify(turns)
    given = spark.createDataFrame([(0, "A parser fails with 403."), (1, None)], "conv_id long, summary string")
    result = compress_with_summary(turns, frames, given)
    method = {r.conv_id: r.method for r in result.summary.collect()}
    assert method == {0: "model", 1: "rule", 2: "whole"}
    first = result.turns.filter("conv_id = 0 AND out_pos = 0").first()
    assert "A parser fails with 403." in first.text
    assert fallback_rate(result.summary).first().asDict() == {"requests": 2, "successes": 1, "fallbacks": 1, "fallback_rate": 0.5}
    asked = {r.conv_id: r.model_input for r in model_summary_input(turns, frames).collect()}
    assert asked[0].startswith("summarize: DOMAIN:coding User: The api throws") and "Assistant: Where?" in asked[0]
