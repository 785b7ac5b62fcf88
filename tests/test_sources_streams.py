"""Round trips through files, and streams against their batch forms."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_usage_reuse import run_once_per_batch, run_stream
from turnloom import schemas
from turnloom.catalog.data_words import TEST
from turnloom.operators.classify import classify
from turnloom.operators.memory import page_sections
from turnloom.operators.reuse import cache_stats
from turnloom.sources import io
from turnloom.streaming.frames import classify_stream
from turnloom.streaming.limits import sessions
from turnloom.streaming.memory import memory_sink, read_sections

START = datetime(2024, 1, 1)
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("lines", [True, False])
def test_eval_cases(spark, tmp_path, lines):
    cases = [
        {"id": "a", "message": "hi", "history": [{"role": "user", "content": "x", "timestamp": "t"}], "expectedRisk": ["crisis"], "mustKeep": ["k"]},
        {"id": "b", "message": "é", "expectedMinSavingsPct": 12.5},
    ]
    path = tmp_path / "cases.json"
    path.write_text("\n".join(map(json.dumps, cases)) if lines else json.dumps(cases, indent=1))
    got = {r.id: r for r in io.read_eval_cases(spark, str(path)).collect()}
    assert got["a"].history[0].content == "x" and got["a"].expectedRisk == ["crisis"] and got["b"].history == [] and got["b"].expectedMinSavingsPct == 12.5
    (tmp_path / "none.json").write_text("")
    assert io.read_eval_cases(spark, str(tmp_path / "none.json")).count() == 0


def test_report_and_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, risk array<string>")
    io.write_report(rows.agg(F.count("*").alias("cases")), rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).first().cases == 2
    assert {r.id: r.risk for r in spark.read.json(str(tmp_path / "r/results")).collect()} == {1: ["a", "b"], 2: []}


def test_usage_facts_are_appended_by_day(spark, tmp_path):
    path = str(tmp_path / "usage_log")
    for day in (1, 2):
        rows = [(day * 10 + i, f"k{i}", "e", START + timedelta(days=day, hours=i), i) for i in range(3)]
        io.append_usage(spark.createDataFrame(rows, schemas.USAGE_LOG), path)
    back = spark.read.parquet(path)
    assert back.count() == 6 and back.select("call_date").distinct().count() == 2


def test_reporting_tables(spark, tmp_path):
    keys = [("k", "h", "n", "o@x", START, None, True, 10, 0)]
    spark.createDataFrame(keys, schemas.API_KEYS).write.parquet(str(tmp_path / "api_keys"))
    spark.createDataFrame([(1, "k", "e", START, 5)], schemas.USAGE_LOG).write.parquet(str(tmp_path / "usage_log"))
    spark.createDataFrame([(1, "n", "e@x", None, START, None)], schemas.KEY_REQUESTS).write.parquet(str(tmp_path / "key_requests"))
    tables = io.read_saas_tables(spark, str(tmp_path))
    assert {k: v.count() for k, v in tables.items()} == {"api_keys": 1, "usage_log": 1, "key_requests": 1}
    assert tables["api_keys"].schema["quota_limit"].dataType.simpleString() == "int"


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "key_id string, v long")
    io.upsert_table(spark, path, frame([("a", 1), ("b", 2)]), ["key_id"])
    io.upsert_table(spark, path, frame([("b", 3), ("c", 4)]), ["key_id"], frame([("a", 0)]).select("key_id"))
    assert {r.key_id: r.v for r in io.read_versioned(spark, path).collect()} == {"b": 3, "c": 4}


def test_payloads(spark):
    plugin = {"id": "p", "label": "P", "keywords": ["k"], "behavior": "b", "constraints": "c"}
    frame = {"intent": "debugging", "state": "opening", "domain": "coding", "risk": [], "signals": {"keywords": ["a"], "structures": [], "urgency": "low", "affect": "neutral"}, "confidence": {"intent": 1, "state": 1, "domain": 1, "risk": 1}}
    row = spark.createDataFrame([(json.dumps([plugin, {"id": "q"}]), json.dumps(frame), '{"intent":""}', "[1", '{"title":"t"}')], "p string, f string, g string, m string, s string").select(
        io.parse_plugins(F.col("p")).alias("p"), io.parse_frame(F.col("f")).alias("f"), io.parse_frame(F.col("g")).alias("g"),
        io.parse_messages(F.col("m")).alias("m"), io.parse_source(F.col("s")).alias("s"),
    ).first()
    assert [p.id for p in row.p] == ["p"] and row.f.domain == "coding" and row.g.domain == "general" and row.m == [] and tuple(row.s) == ("t", "")
    store = spark.createDataFrame([("k", '{"profile":["a"],"version":2}', '{"pages":[{"path":"x"}]}', START)], schemas.MEMORY_STORE)
    back = io.parse_memory_store(store).first()
    assert back.user_memory.profile == ["a"] and back.page_memory.pages[0].path == "x"


def test_frames_of_a_stream(spark, tmp_path):
    words = ["the erer that", "ing nicht for", "de la und", "hello?", "an and of", "mit der que"]
    rows = [(c, t, "user" if (t + c) % 2 == 0 else "assistant", f"{words[(c * 5 + t) % 6]} {words[(c + t) % 5]}") for c in range(4) for t in range(9)]
    rows.sort(key=lambda r: r[1])
    got = run_once_per_batch(spark, [rows[:13], rows[13:20], rows[20:]], TURNS, tmp_path, lambda s: classify_stream(s, vocab=TEST))
    want = classify(spark.createDataFrame(rows, TURNS), vocab=TEST).select("conv_id", "turn", "domain", "intent", "state", "risk").collect()
    assert sorted((r.conv_id, r.turn, r.domain, r.intent, r.state, tuple(r.risk)) for r in got) == sorted((*r[:5], tuple(r.risk)) for r in want)


def test_sessions_of_a_stream(spark, tmp_path):
    schema = "conv_id long, turn long, ts timestamp"
    rows = [(i % 2, i, START + timedelta(minutes=11 * i + (300 if i > 12 else 0))) for i in range(24)]
    late = [(9, 99, START + timedelta(days=5))]
    got = run_stream(spark, [rows[:8], rows[8:], late, [(9, 100, START + timedelta(days=9))]], schema, tmp_path, lambda s: sessions(s, "30 minutes", "1 hour"))
    want = sessions(spark.createDataFrame(rows, schema), "30 minutes").collect()
    assert sorted(r for r in got if r.conv_id < 9) == sorted(want) and len(want) > 3


def test_memory_sink_equals_batch_and_survives_a_retry(spark, tmp_path):
    ddl = "owner string, seq long, source_id string, title string, content string, added_at timestamp, domain string, intent string, state string"
    rows = [(f"o{i % 2}", i, f"s{i}", f"note {i % 5}", f"Alpha beta {i}. Gamma delta.", START + timedelta(minutes=i), "general", "task_execution", "opening") for i in range(24)]
    write = memory_sink(str(tmp_path))
    for batch, part in enumerate((rows[:10], rows[10:17], rows[17:])):
        write(spark.createDataFrame(part, ddl), batch)
    write(spark.createDataFrame(rows[17:], ddl), 2)
    got, want = read_sections(spark, str(tmp_path)), page_sections(spark.createDataFrame(rows, ddl))
    columns = ["owner", "path", "seq", "ord", "markdown"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_cache_stats_counts_live_entries(spark):
    results = spark.createDataFrame([(True, 5), (False, None), (True, 7)], "hit boolean, saved_tokens long")
    live = spark.createDataFrame([(1,), (2,)], "entry_id long")
    assert cache_stats(results, live).first().asDict() == {"total_entries": 2, "total_hits": 2, "total_misses": 1, "hit_rate": 2 / 3, "tokens_saved": 12}
    assert cache_stats(results.limit(0)).first().hit_rate == 0
