from conftest import turns_of
from turnloom.operators.classify import classify, last_frames, predict_labels, model_context
from turnloom.operators.route import route_policy

SINGLE = {
    "Can you teach me how tides work?": ("education", "information_seeking"),
    "The api throws an exception in my function": ("coding", "debugging"),
    "Please refund my order": ("customer_support", "task_execution"),
    "Which discount applies to the premium tier?": ("sales", "decision_support"),
    "I have a fever and a headache": ("medical", "task_execution"),
    "Is this clause fine?": ("legal", "task_execution"),
    "Looking at a new laptop": ("commerce", "task_execution"),
    "Put it on the calendar": ("general", "task_execution"),
    "are you sure the migration is right?": ("coding", "confirmation_seeking"),
    "are you sure the migration order is right?": ("customer_support", "confirmation_seeking"),
    "hello there": ("general", "task_execution"),
}


def frames(spark, conversations, **kw):
    return {r.conv_id: r for r in last_frames(classify(turns_of(spark, conversations), **kw)).collect()}


def test_single_turns(spark):
    got = frames(spark, [[t] for t in SINGLE])
    assert {t: (got[i].domain, got[i].intent) for i, t in enumerate(SINGLE)} == SINGLE
    assert all(r.state == "opening" and r.confidence.state == 0.9 for r in got.values())


def test_ascii_boundaries(spark):
    got = frames(spark, [["éapi"], ["api"], ["api_x"], ["API-key"]])
    assert [got[i].domain for i in range(4)] == ["coding", "coding", "general", "coding"]


def test_look_back_windows(spark):
    six = ["i feel hopeless"] + ["fine"] * 5 + ["hello"]
    seven = ["i feel hopeless"] + ["fine"] * 6 + ["hello"]
    four = ["this is urgent"] + ["fine"] * 3 + ["hello"]
    five = ["this is urgent"] + ["fine"] * 4 + ["hello"]
    both = ["this is urgent and asap"] + ["fine"] * 3 + ["hello"]
    crisis = ["i want to die"] + ["fine"] * 7 + ["hello"]
    got = frames(spark, [six, seven, four, five, both, crisis])
    assert [got[i].signals.affect for i in (0, 1)] == ["distressed", "neutral"]
    assert [got[i].signals.urgency for i in (2, 3, 4)] == ["medium", "low", "high"]
    assert got[4].state == "escalating"
    # the phrase counts in the whole context even when the keyword look-back has passed
    assert got[5].risk == ["crisis", "protected_context"] and "crisis:want to die" not in got[5].signals.keywords


def test_medical_wins_close_scores(spark):
    one_behind = ["my rash; the code and the function"]
    two_behind = ["my rash; the code, the function, the node"]
    got = frames(spark, [one_behind, two_behind])
    assert (got[0].domain, got[1].domain) == ("medical", "coding")


def test_states(spark):
    past = ["my order #A1234 is late", "I see"]
    got = frames(spark, [past + [t] for t in ("thanks", "it still fails", "so what", "ok now tax", "as i said", "tell me")])
    assert [got[i].state for i in range(6)] == ["closing", "escalating", "resolving", "pivoting", "returning", "deepening"]


def test_segments_and_partitions_do_not_matter(spark):
    words = ["refund my order", "it is urgent asap", "hopeless", "nice weather", "error 500 in the api", "price $ 40", "hello"]
    conversations = [[words[(i * k) % 7] for i in range(23)] for k in range(1, 7)]
    turns = turns_of(spark, conversations)
    base = sorted(classify(turns).collect())
    assert sorted(classify(turns, size=3).collect()) == base
    assert sorted(classify(turns.repartition(7), size=1).collect()) == base


def test_plugins_in_order_and_in_history(spark):
    plugins = [
        {"id": "pay", "label": "Pay", "keywords": ["wallet"], "behavior": "Mind compliance.", "constraints": "No approval claims."},
        {"id": "ops", "label": "Ops", "keywords": ["Terraform", "helm chart"], "behavior": "Mind rollback.", "constraints": "Stage first."},
    ]
    turns = turns_of(spark, [["my wallet and terraform"], ["a helm chart", "ok", "what next"], ["debug the api"]])
    routed = {r.conv_id: r for r in route_policy(last_frames(classify(turns, plugins)), plugins).collect()}
    assert [routed[i].domain for i in range(3)] == ["pay", "ops", "coding"]
    assert "No approval claims." in routed[0].system_prompt and "Mind rollback." in routed[1].system_prompt
    assert routed[2].constraints[0].startswith("Preserve technical details")


def test_model_labels_fall_back_to_rules(spark):
    turns = turns_of(spark, [["teach me"], ["hello"]])

    def make():
        import numpy as np

        def predict(texts):
            return {"label": np.array(["sales"] * len(texts), dtype=object), "score": np.full(len(texts), 0.7)}

        return predict

    labels = predict_labels(model_context(turns).filter("conv_id = 1"), make)
    got = {r.conv_id: r for r in classify(turns, domain_labels=labels).collect()}
    assert got[0].domain == "education" and (got[1].domain, got[1].confidence.domain) == ("sales", 0.7)
