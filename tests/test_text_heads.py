"""Texts looked at only as far as needed give what whole texts give; what must not be shuffled is not."""

import random

from pyspark.sql import functions as F

from tests.conftest import turns_of
from turnloom.functions.text import CONCEPT_HEAD, concepts, lead_sentences, ws_trim
from turnloom.operators.memory import page_sections
from turnloom.operators.plugins import first_plugins

PIECES = ["Delft", "Delft Blue", "A", "Ab_c", "longword", "long-word-", "Long-Word", "xy", "nothing.", "End!", "\n", "  ", "Züge", "overview-page", "."]


def test_beginnings_give_what_whole_texts_give(spark):
    rng = random.Random(7)
    texts = [rng.choice(["", " "]).join(rng.choices(PIECES[: rng.randint(3, len(PIECES))], k=rng.choice([0, 3, 150, 400]))) for _ in range(250)]
    texts += ["x " * n + "Overview-Page Next" for n in range(CONCEPT_HEAD // 2 - 12, CONCEPT_HEAD // 2 + 3)] + [" \n" * 2000 + "Late Start. Then more", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    limited, whole = concepts(t, F.lit("note"), 4), F.slice(concepts(t, F.lit("note"), None), 1, 4)
    got = rows.select(t, limited.alias("a"), whole.alias("b"), lead_sentences(t, 10, 70).alias("lead"), lead_sentences(t, 10, 10**6).alias("all"), ws_trim(t).alias("trim")).collect()
    for r in got:
        assert r.a == r.b
        # one long limit reads the whole text; the first sentences are the same up to the cut
        assert r.lead == (None if r.t is None else r["all"][:70])
        assert r.trim == (None if r.t is None else r.t.strip(" \t\n\x0b\f\r "))


def _exchanged(df) -> list[str]:
    """What each shuffle of the plan moves."""
    found = []

    def walk(plan):
        node = plan.nodeName()
        if node.startswith("Exchange"):
            found.append(plan.output().mkString(","))
        inner = plan.executedPlan() if node == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in node else None
        for child in [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_no_whole_text_goes_through_the_join_with_the_trail(spark):
    ddl = "owner string, seq long, source_id string, title string, content string, added_at timestamp, domain string, intent string, state string"
    sections = page_sections(spark.createDataFrame([("a", 1, "s", "t", "Some text.", None, "d", "i", "o")], ddl))
    moved = _exchanged(sections)
    assert moved and not any("content#" in columns for columns in moved)


def test_places_that_no_keyword_begins_like_are_not_shuffled(spark):
    turns = turns_of(spark, [["much text without any of them " * 40] * 3])
    plugins = spark.createDataFrame([(i, f"p{i}", [f"customer {i:03}"]) for i in range(300)], "ord long, id string, keywords array<string>")
    found = first_plugins(turns, plugins, broadcast_bytes=20_000)  # the keywords are shuffled, their beginnings are not
    assert found.count() == 0 and not any("here#" in columns or "gram#" in columns for columns in _exchanged(found) if "conv_id" in columns)
