"""Plugins as a table: the same frames as from a list, first hits against a plain scan."""

import random

import pytest
from conftest import turns_of

from turnloom.operators.classify import MAX_LISTED, classify, last_frames, plugin_list
from turnloom.operators.compress import compress
from turnloom.operators.plugins import first_plugins, plugin_policies
from turnloom.operators.route import route_policy

DDL = "ord long, id string, keywords array<string>, behavior string, constraints string"
LISTED = [
    {"id": "pay", "keywords": ["wallet"], "behavior": "Mind compliance.", "constraints": "No approval claims."},
    {"id": "ops", "keywords": ["Terraform", "helm chart"], "behavior": "Mind rollback.", "constraints": "Stage first."},
]


def table_of(spark, plugins):
    return spark.createDataFrame([(i, *(p.get(k, "") for k in ("id", "keywords", "behavior", "constraints"))) for i, p in enumerate(plugins)], DDL)


def test_table_and_list_give_the_same_frames_prompts_and_compression(spark):
    turns = turns_of(spark, [["my wallet and terraform"], ["a helm chart", "ok", "what next"], ["debug the api"], ["x"] * 5 + ["use Terraform"]])
    table = table_of(spark, LISTED)
    frames = classify(turns, LISTED)
    assert sorted(classify(turns, table, size=2).collect()) == sorted(frames.collect())
    want = sorted(route_policy(last_frames(frames), LISTED).collect())
    assert sorted(route_policy(last_frames(classify(turns, table)), table).collect()) == want
    assert sorted(compress(turns, plugins=table).summary.collect()) == sorted(compress(turns, plugins=LISTED).summary.collect())


def expected(conversations, plugins):
    out = {}
    for cid, texts in enumerate(conversations):
        best = None
        for turn, text in enumerate(texts):
            for i, p in enumerate(plugins):
                if any(k is not None and k.lower() in text.lower() for k in p["keywords"] or ()):
                    best = i if best is None else min(best, i)
            if best is not None:
                out[cid, turn] = plugins[best]["id"]
    return out


def test_first_plugins_against_a_plain_scan(spark):
    rng = random.Random(5)

    def word(n):
        return "".join(rng.choice("abÄ ") for _ in range(n))

    plugins = [{"id": f"p{i}", "keywords": [word(rng.randrange(1, 9)) for _ in range(rng.randrange(4))]} for i in range(60)]
    plugins += [{"id": "none", "keywords": None}, {"id": "null", "keywords": [None]}]
    conversations = [[word(rng.choice((0, 1, 3, 9, 600))) for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    turns, table = turns_of(spark, conversations), table_of(spark, plugins)
    want = expected(conversations, plugins)
    for size, broadcast in ((512, 1 << 20), (3, 0)):
        assert {(r.conv_id, r.turn): r.plugin for r in first_plugins(turns, table, size, broadcast).collect()} == want
    always = [*plugins, {"id": "every", "keywords": [""]}]
    got = {(r.conv_id, r.turn): r.plugin for r in first_plugins(turns, table_of(spark, always)).collect()}
    assert got == expected(conversations, always) and len(got) == sum(map(len, conversations))


def test_empty_tables_and_many_keywords(spark):
    turns = turns_of(spark, [["some text"], ["the key is key 99999 here", "ok", "and key 5 too"]])
    assert first_plugins(turns, table_of(spark, [])).count() == 0
    assert first_plugins(turns.limit(0), table_of(spark, LISTED)).count() == 0
    many = spark.range(100_000).selectExpr("id AS ord", "concat('k', id) AS id", "array(concat('key ', lpad(id, 5, '0'), ' ')) AS keywords", "'' AS behavior", "'' AS constraints")
    assert [(r.conv_id, r.turn, r.plugin) for r in first_plugins(turns, many).orderBy("turn").collect()] == [(1, i, "k99999") for i in range(3)]
    with pytest.raises(ValueError):
        plugin_list(many.limit(MAX_LISTED + 1))


def test_the_first_policy_of_an_id_holds(spark):
    twice = [LISTED[0], {**LISTED[0], "behavior": "Later."}]
    assert [r.plugin_behavior for r in plugin_policies(table_of(spark, twice)).collect()] == ["Mind compliance."]
