"""Signals, lifted features, frames, routing. The SQL runs the same rules on the same vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.registry import lit, query
from turnloom.catalog.tables import VALID_TURNS, conversations
from turnloom.catalog.data_words import PLUGINS, TEST
from turnloom.functions.vocab import (
    DEFAULT,
    DEMO_PROMPTS,
    DOMAIN_POLICY,
    INTENT_POLICY,
    LABEL,
    OTHER_DOMAIN_POLICY,
    RISK_POLICY,
    SCORED_DOMAINS,
    STATE_POLICY,
)
from turnloom.operators import classify as op
from turnloom.operators.route import PROMPT_END, PROMPT_HEAD, REPLIES, canned_reply, demo_prompt, route_policy
from turnloom.sources.io import read_table


def _contains(words, column="low") -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")" if words else "false"


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rules) + f" ELSE {default} END"


def feature_sql(v) -> str:
    """Common table expressions up to ``w``: per-turn flags and their lifts."""
    near = [(g, w) for g in ("crisis", "unsafe", "urgency") for w in v.keyword_groups[g]]
    cols = [f"regexp_matches(low, {lit(r.pattern)}) AS c_{n}" for n, r in v.context.items()]
    cols += [f"regexp_matches(low, {lit(r.pattern)}) AS u_{n}" for n, r in {**v.structures, **v.current}.items()]
    cols += [f"contains(low, {lit(w)}) AS n_{i}" for i, (_, w) in enumerate(near)]
    cols += [f"{_contains(v.affect_words[a])} AS a_{a}" for a in ("distressed", "frustrated", "positive")]
    cols += [f"regexp_matches(low, {lit(v.small_talk.pattern)}) AS small_talk"]
    cols += [f"len(regexp_extract_all(low, {lit(v.scores[d].pattern)})) AS s_{d}" for d in SCORED_DOMAINS]
    cols += [f"{_contains([k.lower() for k in p['keywords']])} AS p_{p['id']}" for p in PLUGINS]
    kw = "[" + ", ".join(
        f"CASE WHEN contains(low, {lit(w)}) THEN {lit(g + ':' + w)} END" for g, ws in v.keyword_groups.items() for w in ws
    ) + "]"
    cols.append(f"list_filter({kw}, lambda x: x IS NOT NULL) AS kw_now")
    lifts = [f"bool_or(c_{n}) OVER ctx AS x_{n}" for n in v.context]
    lifts += [f"coalesce(bool_or(c_{n}) OVER hist, false) AS h_{n}" for n in v.context]
    lifts += [f"sum(s_{d}) OVER ctx AS t_{d}" for d in SCORED_DOMAINS]
    lifts += [f"bool_or(p_{p['id']}) OVER ctx AS q_{p['id']}" for p in PLUGINS]
    early = [(i, g, w) for i, (g, w) in enumerate(near) if g != "urgency"]
    lifts += [f"coalesce(bool_or(n_{i}) OVER last6, false) AS b_{i}" for i, _, _ in early]
    urgent = [i for i, (g, _) in enumerate(near) if g == "urgency"]
    lifts += [f"CAST(bool_or(n_{i}) OVER now4 AS INTEGER) AS g_{i}" for i in urgent]
    lifts += [
        "bool_or(a_distressed) OVER now6 AS distressed",
        "coalesce(bool_or(small_talk) OVER last2, false) AS talk",
        "row_number() OVER seq - 1 AS pos",
        "sum(length(text)) OVER ctx AS context_chars",
    ]
    before = "[" + ", ".join(f"CASE WHEN b_{i} THEN {lit(g + ':' + w)} END" for i, g, w in early) + "]"
    flags = [f"CASE WHEN u_{n} THEN {lit(n)} END" for n in v.structures] + ["CASE WHEN pos > 0 THEN 'has_history' END"]

    def recent(group: str) -> str:
        hit = [f"b_{i} OR n_{i}" for i, g, _ in early if g == group]
        return "(" + " OR ".join(hit) + ")"

    return f"""
t AS (SELECT conv_id, turn, role, text, lower(text) AS low FROM {VALID_TURNS}),
f AS (SELECT *, {", ".join(cols)} FROM t),
l AS (SELECT *, {", ".join(lifts)} FROM f WINDOW
  seq AS (PARTITION BY conv_id ORDER BY turn),
  ctx AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  hist AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  last6 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  now6 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  now4 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  last2 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
w AS (SELECT *,
  list_concat(kw_now, list_filter({before}, lambda x: x IS NOT NULL AND NOT list_contains(kw_now, x))) AS keywords,
  list_filter([{", ".join(flags)}], lambda x: x IS NOT NULL) AS structures,
  CASE WHEN {" + ".join(f"g_{i}" for i in urgent)} >= 2 THEN 'high' WHEN {" + ".join(f"g_{i}" for i in urgent)} = 1 THEN 'medium' ELSE 'low' END AS urgency,
  CASE WHEN distressed THEN 'distressed' WHEN a_frustrated THEN 'frustrated' WHEN a_positive THEN 'positive' ELSE 'neutral' END AS affect,
  {recent("crisis")} OR x_crisis_phrase AS crisis, {recent("unsafe")} OR x_unsafe_phrase AS unsafe,
  t_coding + CASE WHEN u_code_block OR u_error_signal THEN 3 ELSE 0 END AS z_coding,
  t_customer_support AS z_customer_support, t_sales AS z_sales, t_legal AS z_legal, t_medical AS z_medical,
  t_commerce + CASE WHEN u_price_constraint THEN 2 ELSE 0 END AS z_commerce, t_education AS z_education
  FROM l)"""


def frame_sql(v, plugins=()) -> str:
    """Common table expressions up to ``frames``, one row per user turn."""
    best = "greatest(" + ", ".join(f"z_{d}" for d in SCORED_DOMAINS) + ")"
    by_score = _case(
        [(f"{best} = 0", "'general'"), (f"z_medical > 0 AND {best} - z_medical <= 1", "'medical'")]
        + [(f"z_{d} = {best}", lit(d)) for d in SCORED_DOMAINS],
        "'general'",
    )
    domain = _case(
        [(f"q_{p['id']}", lit(p["id"])) for p in plugins]
        + [
            ("x_self_harm", "'general'"),
            ("u_teaching", "'education'"),
            ("u_scheduling", "'general'"),
            ("x_tone_edit", "'general'"),
            ("x_hosting", "'commerce'"),
            ("x_support_verb AND x_order_reference", "'customer_support'"),
            ("x_device", "'commerce'"),
            ("x_stack", "'coding'"),
            ("u_clinical", "'medical'"),
            ("x_deal", "'sales'"),
            ("x_budget AND NOT x_technical", "'sales'"),
            ("u_contract", "'legal'"),
            ("u_legal_word AND x_legal_advice", "'legal'"),
            ("u_support_word", "'customer_support'"),
        ],
        by_score,
    )
    intent = _case(
        [
            ("u_cover_up", "'task_execution'"),
            ("u_confirm", "'confirmation_seeking'"),
            ("u_error_signal OR u_failure", "'debugging'"),
            ("domain = 'coding' AND x_build_work", "'generation'"),
            ("domain = 'coding' AND x_fault_work", "'debugging'"),
            ("u_compare", "'comparison'"),
            ("domain = 'commerce' AND x_product_choice", "'comparison'"),
            ("u_summarize", "'summarization'"),
            ("domain = 'education' AND u_review AND x_summary_topic", "'summarization'"),
            ("u_correct_text", "'correction'"),
            ("u_produce", "'generation'"),
            ("domain = 'medical' AND x_care_question", "'information_seeking'"),
            ("domain = 'medical' AND u_safety_question", "'decision_support'"),
            ("domain = 'legal' AND u_legal_choice", "'decision_support'"),
            ("u_decide", "'decision_support'"),
            (
                "domain = 'sales' AND x_deal_topic",
                "CASE WHEN u_deal_forward THEN 'decision_support' WHEN u_deal_doubt THEN 'objection_handling' ELSE 'decision_support' END",
            ),
            ("u_disagree", "'correction'"),
            (
                "domain = 'customer_support' AND x_support_topic",
                "CASE WHEN x_support_escalation THEN 'escalation' WHEN u_when_status THEN 'information_seeking' ELSE 'task_execution' END",
            ),
            ("domain = 'education' AND u_next_lesson", "'information_seeking'"),
            ("u_schedule_task", "'task_execution'"),
            ("u_question", "'information_seeking'"),
            ("u_ideas", "'exploration'"),
            ("u_hesitation", "'objection_handling'"),
            ("urgency = 'high' OR u_resolve_now", "CASE WHEN domain = 'customer_support' THEN 'escalation' ELSE 'task_execution' END"),
            ("u_generic_reference AND domain = 'coding'", "'debugging'"),
        ],
        "'task_execution'",
    )
    state = _case(
        [
            ("pos = 0", "'opening'"),
            ("u_alarm", "'escalating'"),
            ("u_thanks", "'closing'"),
            ("urgency = 'high' OR u_persistence", "'escalating'"),
            ("h_unresolved_call", "'escalating'"),
            ("u_conclude OR u_act", "'resolving'"),
            ("u_new_topic", "'pivoting'"),
            ("u_back_reference", "'returning'"),
            ("talk AND domain <> 'general'", "'returning'"),
        ],
        "'deepening'",
    )
    risk = (
        "list_filter([CASE WHEN crisis THEN 'crisis' END, CASE WHEN crisis THEN 'protected_context' END, "
        "CASE WHEN unsafe THEN 'unsafe_request' END, CASE WHEN domain = 'medical' THEN 'medical_caution' END, "
        "CASE WHEN domain = 'legal' THEN 'legal_caution' END, CASE WHEN domain = 'commerce' AND "
        "len(list_filter(keywords, lambda k: contains(k, 'invest') OR contains(k, 'price'))) > 0 THEN 'financial_caution' END], "
        "lambda x: x IS NOT NULL)"
    )
    boost = "least(0.16, (len(keywords) + len(structures)) * 0.025)"
    return f"""{feature_sql(v)},
d AS (SELECT *, {domain} AS domain FROM w WHERE role = 'user'),
i AS (SELECT *, {intent} AS intent, {state} AS state, {risk} AS risk FROM d),
frames AS (SELECT *, round(least(0.96, (CASE WHEN intent = 'task_execution' THEN 0.68 ELSE 0.78 END) + {boost}), 2) AS conf_intent,
  CASE WHEN state = 'opening' THEN 0.9 ELSE 0.74 END AS conf_state,
  CASE WHEN domain = 'general' THEN 0.62 ELSE 0.88 END AS conf_domain,
  CASE WHEN len(risk) = 0 THEN 1.0 ELSE 0.88 END AS conf_risk FROM i)"""


FRAMES = "WITH " + frame_sql(TEST)
FEATURES = "WITH " + feature_sql(TEST)


def frames(spark, path, vocab=TEST, plugins=None):
    return op.classify(conversations(spark, path), plugins, vocab)


def features(spark, path):
    rows, view = op.lifted_columns(conversations(spark, path), TEST)
    return rows, view


@query("keyword_signals", f"{FRAMES} SELECT conv_id, turn, array_to_string(keywords, '|') AS keywords FROM frames")
def keyword_signals(spark, path):
    return frames(spark, path).select("conv_id", "turn", F.array_join("signals.keywords", "|").alias("keywords"))


@query("structure_flags", f"{FRAMES} SELECT conv_id, turn, array_to_string(structures, '|') AS structures FROM frames")
def structure_flags(spark, path):
    return frames(spark, path).select("conv_id", "turn", F.array_join("signals.structures", "|").alias("structures"))


@query("urgency", f"{FEATURES} SELECT conv_id, turn, urgency FROM w")
def urgency(spark, path):
    rows, f = features(spark, path)
    return rows.select("conv_id", "turn", f.urgency().alias("urgency"))


@query("affect", f"{FEATURES} SELECT conv_id, turn, affect FROM w")
def affect(spark, path):
    rows, f = features(spark, path)
    return rows.select("conv_id", "turn", f.affect().alias("affect"))


@query(
    "context_features",
    f"{FEATURES} SELECT conv_id, turn, pos, context_chars, "
    + ", ".join(f"CAST(x_{n} AS INTEGER) AS ctx_{n}" for n in TEST.context)
    + " FROM w",
)
def context_features(spark, path):
    rows, f = features(spark, path)
    return rows.select(
        "conv_id",
        "turn",
        "pos",
        f.context_chars().alias("context_chars"),
        *[f.ctx(n).cast("int").alias(f"ctx_{n}") for n in TEST.context],
    )


@query(
    "history_features",
    f"{FEATURES} SELECT conv_id, turn, " + ", ".join(f"CAST(h_{n} AS INTEGER) AS hist_{n}" for n in TEST.context) + " FROM w",
)
def history_features(spark, path):
    rows, f = features(spark, path)
    return rows.select("conv_id", "turn", *[f.hist(n).cast("int").alias(f"hist_{n}") for n in TEST.context])


@query(
    "recent_features",
    f"{FEATURES} SELECT conv_id, turn, crisis, unsafe, distressed, talk AS small_talk_before FROM w",
)
def recent_features(spark, path):
    rows, f = features(spark, path)
    return rows.select(
        "conv_id",
        "turn",
        (f.near_group("crisis", 6) | f.ctx("crisis_phrase")).alias("crisis"),
        (f.near_group("unsafe", 6) | f.ctx("unsafe_phrase")).alias("unsafe"),
        (f.affect() == "distressed").alias("distressed"),
        f.small_talk_before().alias("small_talk_before"),
    )


@query(
    "domain_scores",
    f"{FEATURES} SELECT conv_id, turn, " + ", ".join(f"CAST(z_{d} AS BIGINT) AS {d}" for d in SCORED_DOMAINS) + " FROM w",
)
def domain_scores(spark, path):
    rows, f = features(spark, path)
    return rows.select("conv_id", "turn", *[c.alias(d) for d, c in op.domain_scores(f).items()])


for _name in ("domain", "intent", "state"):

    def _label(spark, path, name=_name):
        return frames(spark, path).select("conv_id", "turn", name)

    query(_name, f"{FRAMES} SELECT conv_id, turn, {_name} FROM frames")(_label)


@query("risk", f"{FRAMES} SELECT conv_id, turn, array_to_string(risk, '|') AS risk FROM frames")
def risk(spark, path):
    return frames(spark, path).select("conv_id", "turn", F.array_join("risk", "|").alias("risk"))


@query("confidence", f"{FRAMES} SELECT conv_id, turn, conf_intent, conf_state, conf_domain, conf_risk FROM frames")
def confidence(spark, path):
    c = F.col("confidence")
    return frames(spark, path).select(
        "conv_id", "turn", *[c[n].alias(f"conf_{n}") for n in ("intent", "state", "domain", "risk")]
    )


_FRAME_COLUMNS = """conv_id, turn, pos, intent, state, domain, array_to_string(risk, '|') AS risk,
array_to_string(keywords, '|') AS keywords, array_to_string(structures, '|') AS structures, urgency, affect, conf_intent, conf_domain"""


def flat_frames(df):
    return df.select(
        "conv_id",
        "turn",
        "pos",
        "intent",
        "state",
        "domain",
        F.array_join("risk", "|").alias("risk"),
        F.array_join("signals.keywords", "|").alias("keywords"),
        F.array_join("signals.structures", "|").alias("structures"),
        "signals.urgency",
        "signals.affect",
        F.col("confidence.intent").alias("conf_intent"),
        F.col("confidence.domain").alias("conf_domain"),
    )


@query("frames", f"{FRAMES} SELECT {_FRAME_COLUMNS} FROM frames")
def all_frames(spark, path):
    return flat_frames(frames(spark, path))


@query("frames_default_vocabulary", f"WITH {frame_sql(DEFAULT)} SELECT {_FRAME_COLUMNS} FROM frames")
def default_frames(spark, path):
    return flat_frames(frames(spark, path, DEFAULT))


_PLUGGED = "WITH " + frame_sql(TEST, PLUGINS)


@query("plugin_domain", f"{_PLUGGED} SELECT conv_id, turn, domain, intent, state FROM frames")
def plugin_domains(spark, path):
    return frames(spark, path, TEST, PLUGINS).select("conv_id", "turn", "domain", "intent", "state")


def plugin_table(spark, path):
    """The short list, and behind it every customer as a plugin whose keyword is the customer's name."""
    listed = [(i, p["id"], p["keywords"], p["behavior"], p["constraints"]) for i, p in enumerate(PLUGINS)]
    ddl = "ord long, id string, keywords array<string>, behavior string, constraints string"
    customers = read_table(spark, path, "customer").select(
        (F.col("c_custkey") + len(listed)).cast("long").alias("ord"),
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("id"),
        F.array("c_name").alias("keywords"),
        F.lit("Use the customer's records.").alias("behavior"),
        F.lit("Only this customer's records.").alias("constraints"),
    )
    return spark.createDataFrame(listed, ddl).unionByName(customers)


@query("plugin_table_domain", f"{_PLUGGED} SELECT conv_id, turn, domain, intent, state FROM frames")
def plugin_table_domain(spark, path):
    out = frames(spark, path, TEST, plugin_table(spark, path))
    return out.select("conv_id", "turn", "domain", "intent", "state")


@query(
    "domain_from_labels",
    f"""{FRAMES}, lab AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'sales' WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN 'medical' END AS label FROM frames)
SELECT conv_id, turn, coalesce(label, domain) AS domain, coalesce(CASE WHEN label IS NOT NULL THEN 0.5 + turn / 100.0 END, conf_domain) AS conf_domain FROM lab""",
)
def domain_from_labels(spark, path):
    turns = conversations(spark, path)
    label = F.when(F.col("turn") % 4 == 0, F.lit("sales")).when(
        (F.col("turn") % 4 == 2) & (F.col("conv_id") % 2 == 0), F.lit("medical")
    )
    labels = turns.select("conv_id", "turn", label.alias("label"), (F.lit(0.5) + F.col("turn") / 100.0).alias("score"))
    labels = labels.filter(F.col("label").isNotNull())
    out = op.classify(turns, None, TEST, domain_labels=labels)
    return out.select("conv_id", "turn", "domain", F.col("confidence.domain").alias("conf_domain"))


@query(
    "model_context",
    f"""WITH t AS (SELECT conv_id, turn, role, lower(text) AS low FROM {VALID_TURNS}),
h AS (SELECT a.conv_id, a.turn, a.low, string_agg(b.low, chr(10) ORDER BY b.turn) AS past FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn < a.turn
  WHERE a.role = 'user' GROUP BY a.conv_id, a.turn, a.low)
SELECT conv_id, turn, left(left(low, 512) || chr(10) || coalesce(past, ''), 512) AS context FROM h""",
)
def model_contexts(spark, path):
    return op.model_context(conversations(spark, path))


def _policy(column: str, table: dict, default: str = "NULL") -> str:
    return _case([(f"{column} = {lit(k)}", lit(t)) for k, t in table.items()], default)


def route_ctes(plugins=()) -> str:
    """CTEs up to routed(conv_id, turn, system_prompt) over frames."""
    own = [(f"domain = {lit(p['id'])}", f"nullif({lit(p['behavior'])}, '')") for p in plugins]
    ruled = [(f"domain = {lit(p['id'])}", lit(p["constraints"])) for p in plugins]
    fixed = _policy("domain", DOMAIN_POLICY, lit(OTHER_DOMAIN_POLICY))
    return f"""pr AS (SELECT conv_id, turn, intent, state, domain, risk,
  list_filter([{_policy('intent', INTENT_POLICY)}, {_policy('state', STATE_POLICY)}, {_case(own, 'NULL') if own else 'NULL'}], lambda x: x IS NOT NULL) AS behavior,
  list_concat([{_case(ruled, fixed) if ruled else fixed}],
    list_filter([{", ".join(f"CASE WHEN list_contains(risk, {lit(k)}) THEN {lit(t)} END" for k, t in RISK_POLICY)}], lambda x: x IS NOT NULL)) AS constraints
  FROM frames),
routed AS (SELECT conv_id, turn, {lit(PROMPT_HEAD.replace('{label}', LABEL))} || chr(10) ||
  'Intent: ' || intent || '. State: ' || state || '. Domain: ' || domain || '.' || chr(10) ||
  'Behavior: ' || array_to_string(behavior, ' ') || chr(10) || 'Constraints: ' || array_to_string(constraints, ' ') || chr(10) ||
  {lit(PROMPT_END)} AS system_prompt FROM pr)"""


_ROUTE = f"{_PLUGGED}, {route_ctes(PLUGINS)} SELECT conv_id, turn, system_prompt FROM routed"


@query("route_policy", _ROUTE)
def routed(spark, path):
    out = route_policy(frames(spark, path, TEST, PLUGINS), PLUGINS)
    return out.select("conv_id", "turn", "system_prompt")


@query("plugin_table_policy", _ROUTE)
def plugin_table_policy(spark, path):
    plugins = plugin_table(spark, path)
    return route_policy(frames(spark, path, TEST, plugins), plugins).select("conv_id", "turn", "system_prompt")


@query(
    "protected_split",
    f"""{FRAMES} SELECT conv_id, turn, domain IN ('medical', 'legal') OR list_contains(risk, 'crisis') AS protected,
CASE WHEN domain IN ('medical', 'legal') OR list_contains(risk, 'crisis') THEN 'elevated' ELSE 'standard' END AS retention FROM frames""",
)
def protected_split(spark, path):
    return op.protected_gate(frames(spark, path)).select("conv_id", "turn", "protected", "retention")


@query(
    "reuse_tiers",
    f"""{FRAMES} SELECT conv_id, turn, domain <> 'legal' AS cacheable,
domain IN ('customer_support', 'commerce', 'education', 'medical', 'coding') AS high_reuse FROM frames""",
)
def reuse_tiers(spark, path):
    return frames(spark, path).select(
        "conv_id", "turn", op.cacheable(F.col("domain")).alias("cacheable"), op.high_reuse(F.col("domain")).alias("high_reuse")
    )


@query(
    "demo_prompt",
    f"{FRAMES} SELECT conv_id, turn, {_policy('domain', DEMO_PROMPTS, lit(DEMO_PROMPTS['general']))} AS prompt FROM frames",
)
def demo_prompts(spark, path):
    return frames(spark, path).select("conv_id", "turn", demo_prompt(F.col("domain")).alias("prompt"))


_REPLY = _case(
    [
        ("list_contains(risk, 'unsafe_request')", "'unsafe'"),
        ("intent = 'debugging'", "'debug'"),
        ("domain = 'customer_support'", "'support'"),
        ("domain = 'sales'", "'sales'"),
        ("domain IN ('legal', 'medical')", "'caution'"),
        ("intent = 'comparison'", "'compare'"),
        ("intent = 'summarization'", "'summary'"),
        ("intent = 'generation'", "'artifact'"),
    ],
    "'routed'",
)


_REPLY_TEXT = "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {lit(v.replace('{label}', LABEL))}" for k, v in REPLIES.items()) + " END"


@query(
    "canned_reply",
    f"""{FRAMES}, k AS (SELECT conv_id, turn, intent, domain, {_REPLY} AS kind FROM frames)
SELECT conv_id, turn, replace(replace(replace({_REPLY_TEXT}, '{{kept}}', '1'), '{{domain}}', domain), '{{intent}}', intent) AS reply FROM k""",
)
def canned_replies(spark, path):
    reply = canned_reply(F.col("intent"), F.col("domain"), F.col("risk"), F.lit(1))
    return frames(spark, path).select("conv_id", "turn", reply.alias("reply"))
