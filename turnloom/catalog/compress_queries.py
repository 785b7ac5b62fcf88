"""Turn relevance, focus and anchor turns, facts, compression."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from turnloom.catalog.classify_queries import FRAMES, frame_sql, route_ctes
from turnloom.catalog.registry import lit, query
from turnloom.catalog.tables import VALID_TURNS, conversations, documents
from turnloom.catalog.data_words import TEST
from turnloom.functions.facts import contained_count, entity_budget, extract_facts, rank_facts
from turnloom.functions.vocab import (
    CONSTRAINT_PATTERNS,
    DEFAULT,
    DOMAIN_CONSTRAINTS,
    DOMAIN_LEADS,
    DOMAINS,
    HARD_FACT_PATTERNS,
    HIGH_VALUE_DOMAINS,
    IMPORTANT_FACTS,
    LABEL,
    OTHER_DOMAIN_LEAD,
    UNRESOLVED_PATTERNS,
)
from turnloom.operators import compress as op
from turnloom.operators.classify import classify
from turnloom.operators.handle import handle
from turnloom.operators.hard_facts import hard_facts
from turnloom.operators.relevance import scored_turns
from turnloom.operators.turns import valid_turns

# a fixed domain per conversation and fixed facts, so that every branch of the scoring is exercised
FACTS = ("that", "erer", "ing th", "de la", "nicht", "for")
_DOMAIN = "[" + ", ".join(lit(d) for d in (*DOMAINS, "other")) + "][1 + conv_id % 9]"


def _count(pattern: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all(text, {lit(flags + pattern)}))"


def _hit(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def _by_domain(branches: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN domain = {lit(d)} THEN {e}" for d, e in branches.items()) + f" ELSE {default} END"


def _off_topic(vocab) -> str:
    words = [f"CASE WHEN {_hit(chr(92) + 'b' + w + chr(92) + 'b', 'low')} THEN 3 ELSE 0 END" for w in vocab.distractors]
    extra = [f"CASE WHEN {_hit(p, 'low')} THEN {n} ELSE 0 END" for p, n in vocab.extra_distractors]
    return " + ".join(words + extra)


def score_ctes(vocab) -> str:
    """CTEs from t0(conv_id, turn, role, text, low, domain, pos, n) to sc, with base: the relevance without known facts."""
    return f"""t1 AS (SELECT *, {_by_domain({d: _count(p) for d, p in vocab.domain_patterns.items()}, _count(chr(92) + 'w+'))} AS ds, {_off_topic(vocab)} AS off,
  {_by_domain({d: f"CASE WHEN {_hit(p)} THEN {n} ELSE 0 END" for d, (p, n) in vocab.structure_boosts.items()}, '0')} AS sb,
  {_by_domain({d: f"CASE WHEN {_hit(r.pattern, 'low')} THEN {n} ELSE 0 END" for d, (r, n) in vocab.action_boosts.items()}, '0')} AS ab FROM t0),
t2 AS (SELECT *, CASE WHEN ds > 0 THEN greatest(0, off - 2) ELSE off END AS o1 FROM t1),
t3 AS (SELECT *, CASE WHEN {_hit(vocab.on_topic.pattern, 'low')} THEN greatest(0, o1 - 3) ELSE o1 END AS o2 FROM t2),
sc AS (SELECT *, ds + sb + ab - CASE WHEN contains(low, 'requests') AND contains(low, 'python') THEN greatest(0, o2 - 2) ELSE o2 END AS base FROM t3)"""


SCORES = f"""WITH t0 AS (SELECT conv_id, turn, role, text, lower(text) AS low, {_DOMAIN} AS domain,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM {VALID_TURNS}),
{score_ctes(TEST).replace("sc AS", "base AS")},
sc AS (SELECT *, base + 3 * len(list_filter([{', '.join(lit(f) for f in FACTS)}], lambda f: contains(low, f))) AS relevance FROM base)"""


def placed(spark, path):
    turns = conversations(spark, path)
    names = F.array(*[F.lit(d) for d in (*DOMAINS, "other")])
    heads = valid_turns(turns).groupBy("conv_id").agg(F.max("turn").alias("current_turn"), F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("domain", F.get(names, (F.col("conv_id") % 9).cast("int")))
    rows = op.placed_rows(op.turn_rows(turns), op.segment_heads(turns, heads))
    return scored_turns(rows, TEST).withColumn("facts", F.array(*[F.lit(f) for f in FACTS]))


@query("turn_relevance", f"{SCORES} SELECT conv_id, turn, domain, CAST(relevance AS BIGINT) AS relevance FROM sc")
def turn_relevance(spark, path):
    score = F.expr("base_score + 3 * " + contained_count("facts", "low"))
    return placed(spark, path).select("conv_id", "turn", "domain", score.cast("long").alias("relevance"))


@query(
    "focus_turns",
    f"""{SCORES}, f AS (SELECT *, relevance + CASE WHEN role = 'user' THEN 0.75 ELSE 0.0 END + pos / greatest(1, n) AS s FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN s >= 2.5 THEN s END DESC NULLS LAST, pos DESC) AS rk FROM f),
k AS (SELECT *, bool_or(s >= 2.5) OVER (PARTITION BY conv_id) AS any_ok FROM r WHERE rk <= 3)
SELECT conv_id, pos, role, rk AS rank FROM k WHERE s >= 2.5 OR NOT any_ok""",
)
def focus_turns(spark, path):
    rows = placed(spark, path)
    score = F.expr(op.focus_score("base_score", "facts", "low", "role", "pos"))
    ranked = rows.select("conv_id", "pos", "role", "text", op.best_first(score, op.FOCUS_SCORE).alias("rank_score"))
    best = op.top_focus(ranked, 3)
    some = best.groupBy("conv_id").agg(F.bool_or(F.col("rank_score").isNotNull()).alias("some"))
    kept = best.join(some, "conv_id").filter(F.col("rank_score").isNotNull() | ~F.col("some"))
    return kept.select("conv_id", "pos", "role", "rank")


@query(
    "anchor_turns",
    f"""{SCORES}, f AS (SELECT *, relevance + pos / greatest(1, n) AS s FROM sc)
SELECT conv_id, pos, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, pos DESC) AS rk FROM f WHERE s >= 4) WHERE rk <= 2""",
)
def anchor_turns(spark, path):
    rows = placed(spark, path)
    score = F.expr(op.anchor_score("base_score", "facts", "low", "pos"))
    ranked = rows.select("conv_id", "pos", "role", "text", op.best_first(score, op.ANCHOR_SCORE).alias("rank_score"))
    return op.top_focus(ranked.filter(F.col("rank_score").isNotNull()), 2).select("conv_id", "pos", "rank")


@query(
    "rescue_turns",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS cur FROM {VALID_TURNS}),
c AS (SELECT conv_id, pos, len(list_filter([{', '.join(lit(f) for f in FACTS)}], lambda f: contains(lower(text), f))) AS coverage
  FROM v WHERE turn <= cur AND pos <> 1)
SELECT conv_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coverage DESC, pos) AS rk FROM c WHERE coverage > 0) WHERE rk <= 2""",
)
def rescued(spark, path):
    turns = conversations(spark, path)
    users = valid_turns(turns).filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("current_turn"))
    wanted = users.withColumns(
        {"missing": F.array(*[F.lit(f) for f in FACTS]), "kept": F.array(F.lit(1).cast("long"))}
    )
    found = op.rescue_turns(turns, wanted)
    return found.select("conv_id", F.explode("rescue").alias("m")).select("conv_id", F.col("m.pos").alias("pos"))


def _facts_sql(vocab, source: str) -> str:
    own = _by_domain(
        {
            d: "list_concat(" + ", ".join(f"regexp_extract_all(text, {lit(p)})" for p in ps if p != "CODE_BLOCK") + ", [])"
            for d, ps in vocab.fact_patterns.items()
        },
        "[]",
    )
    common = ", ".join(f"regexp_extract_all(text, {lit(p)})" for p in vocab.common_facts)
    score = (
        "CASE WHEN regexp_matches(v, '[#/]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(v, '[0-9]') THEN 2 ELSE 0 END + "
        "CASE WHEN contains(v, ' ') THEN 1 ELSE 0 END + "
        + _by_domain({d: f"CASE WHEN regexp_matches(v, {lit(p)}) THEN 4 ELSE 0 END" for d, p in IMPORTANT_FACTS.items()}, "0")
    )
    return f"""WITH src AS ({source}), a AS (SELECT id, domain, list_concat({own}, {common}) AS l FROM src),
u AS (SELECT id, domain, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM a),
c AS (SELECT id, domain, i, regexp_replace(trim(r), '^[''"]|[''"]$', '', 'g') AS v FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(v) ORDER BY i) AS rn FROM c WHERE length(v) BETWEEN 2 AND 160),
s AS (SELECT id, domain, i, v, {score} AS score FROM k WHERE rn = 1)"""


_DOC_DOMAIN = "SELECT doc_id AS id, text, [" + ", ".join(lit(d) for d in (*DOMAINS, "other")) + "][1 + doc_id % 9] AS domain FROM documents"


def doc_domains(spark, path):
    names = F.array(*[F.lit(d) for d in (*DOMAINS, "other")])
    return documents(spark, path).select("doc_id", "text", F.get(names, (F.col("doc_id") % 9).cast("int")).alias("domain"))


@query(
    "facts",
    _facts_sql(TEST, _DOC_DOMAIN) + " SELECT id AS doc_id, md5(string_agg(v, '|' ORDER BY i)) AS facts_md5, count(*) AS n FROM s GROUP BY id",
)
def facts(spark, path):
    found = doc_domains(spark, path).withColumn("f", extract_facts("text", "domain", TEST)).filter(F.size("f") > 0)
    return found.select("doc_id", F.md5(F.array_join("f", "|")).alias("facts_md5"), F.size("f").cast("long").alias("n"))


@query(
    "rank_facts",
    _facts_sql(DEFAULT.with_(fact_patterns={**TEST.fact_patterns}), _DOC_DOMAIN)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(v), i) AS rk FROM s)
SELECT id AS doc_id, string_agg(v, '|' ORDER BY rk) AS best FROM r WHERE rk <= 10 GROUP BY id""",
)
def ranked(spark, path):
    found = doc_domains(spark, path).withColumn("f", extract_facts("text", "domain", TEST)).filter(F.size("f") > 0)
    return found.select("doc_id", F.array_join(rank_facts("f", "domain", 10), "|").alias("best"))


_HARD = " UNION ALL ".join(
    f"SELECT id, {i} AS family, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all(text, {lit(p)}, {g}) AS l FROM src"
    + (f" WHERE domain = {lit(d)}" if d else "")
    + ")"
    for i, (p, d, g) in enumerate(HARD_FACT_PATTERNS)
)


@query(
    "hard_facts",
    f"""WITH src AS ({_DOC_DOMAIN}), u AS ({_HARD}), c AS (SELECT id, trim(r, ' ' || chr(10) || chr(9) || chr(13)) AS v, family, i FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(v) ORDER BY family, i) AS rn FROM c WHERE length(v) >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY family, i) AS rk FROM k WHERE rn = 1),
l AS (SELECT id, list([v] ORDER BY rk) AS vs FROM o WHERE rk <= 20 GROUP BY id)
SELECT id AS doc_id, array_to_string(list_reduce(vs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: contains(lower(y), lower(x[1])) AND y <> x[1])) > 0
  THEN acc ELSE list_concat(acc, x) END)[1:12], '|') AS hard_facts FROM l""",
)
def hard_fact_lists(spark, path):
    rows = doc_domains(spark, path).select(
        F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("pos"), "text", "domain"
    )
    found = hard_facts(rows)
    return found.select(F.col("conv_id").alias("doc_id"), F.array_join("hard_facts", "|").alias("hard_facts"))


@query(
    "entity_budget",
    f"""{FRAMES} SELECT conv_id, turn, CASE WHEN domain = 'coding' AND intent = 'generation' THEN 8
WHEN domain IN ('legal', 'medical', 'commerce', 'general') THEN 7 WHEN domain IN ('coding', 'customer_support', 'sales') THEN 6 ELSE 5 END AS budget FROM frames""",
)
def budgets(spark, path):
    f = classify(conversations(spark, path), vocab=TEST)
    return f.select("conv_id", "turn", entity_budget(F.col("domain"), F.col("intent")).alias("budget"))


def _fact_ctes(name: str, vocab, source: str) -> str:
    """CTEs up to {name}_r(id, v, rk): the facts of source(id, text, domain), best first."""
    body = _facts_sql(vocab, source)[len("WITH ") :]
    for cte in ("src", "a", "u", "c", "k", "s"):
        body = re.sub(rf"(^|\n|, )\b{cte} AS \(", rf"\g<1>{name}_{cte} AS (", body)
        body = re.sub(rf"FROM {cte}\b", f"FROM {name}_{cte}", body)
    return f"{body}, {name}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(v), i) AS rk FROM {name}_s)"


def _distinct_ctes(name: str, items: str, limit: int) -> str:
    """CTEs up to {name}(id, l): the first distinct entries of items(id, l)."""
    return f"""{name}_u AS (SELECT id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM ({items})),
{name}_c AS (SELECT id, i, regexp_replace(trim(r), '^[''"]|[''"]$', '', 'g') AS v FROM {name}_u),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(v) ORDER BY i) AS rn FROM {name}_c WHERE length(v) BETWEEN 2 AND 160),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rk FROM {name}_k WHERE rn = 1),
{name} AS (SELECT id, list(v ORDER BY rk) AS l FROM {name}_o WHERE rk <= {limit} GROUP BY id)"""


def _all(patterns) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(text, {lit(p)})" for p in patterns) + ", [])"


def _unique(items: str) -> str:
    return f"list_filter({items}, lambda x, i: len(list_filter(({items})[1:i - 1], lambda e: e.role = x.role AND e.text = x.text)) = 0)"


def _sentence(text: str) -> str:
    return f"left(regexp_replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '[|]', '', 'g'), 96)"


def _unresolved() -> str:
    branches = {}
    for d, (guard, items) in UNRESOLVED_PATTERNS.items():
        found = f"regexp_extract_all(text, {lit(items)})"
        ok = f"regexp_matches(lower(text), {lit(guard)})" if guard else "true"
        ok = f"({ok} OR intent = 'summarization')" if d == "education" else ok
        branches[d] = f"CASE WHEN {ok} THEN {found} ELSE [] END"
    return _by_domain(branches, "[]")


def _overlap(facts: str) -> str:
    return f"len(list_filter(coalesce({facts}, []), lambda f: length(f) >= 3 AND contains(low, f)))"


_HIGH = "domain IN (" + ", ".join(lit(d) for d in HIGH_VALUE_DOMAINS) + ")"
_BUDGET = """CASE WHEN domain = 'coding' AND intent = 'generation' THEN 8 WHEN domain IN ('legal', 'medical', 'commerce', 'general') THEN 7
  WHEN domain IN ('coding', 'customer_support', 'sales') THEN 6 ELSE 5 END"""


def _chosen(name: str, score: str, limit: str) -> str:
    """CTEs up to {name}(conv_id, m): the best turns in turn order; repeated ones once if any reaches the score."""
    return f"""{name}_s AS (SELECT *, {score} AS s FROM sc),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN s >= {op.FOCUS_SCORE} THEN s END DESC NULLS LAST, pos DESC) AS rk FROM {name}_s),
{name}_k AS (SELECT *, bool_or(s >= {op.FOCUS_SCORE}) OVER (PARTITION BY conv_id) AS good FROM {name}_r WHERE rk <= {limit}),
{name}_l AS (SELECT conv_id, any_value(good) AS good, any_value(domain) AS domain, list({{'pos': pos, 'role': role, 'text': text}} ORDER BY pos) AS l
  FROM {name}_k WHERE s >= {op.FOCUS_SCORE} OR NOT good GROUP BY conv_id),
{name} AS (SELECT conv_id, domain, CASE WHEN good THEN {_unique('l')} ELSE l END AS m FROM {name}_l)"""


def memory_sql(vocab) -> str:
    """CTEs up to mem, one memory frame per conversation, and sc, its turns with their base score."""
    goal = """CASE WHEN latest <> '' THEN {} END""".format(
        _sentence(
            "(CASE WHEN intent = 'debugging' THEN 'Resolve ' WHEN intent = 'generation' THEN 'Produce ' WHEN domain = 'customer_support' THEN "
            "'Support request: ' WHEN domain = 'sales' THEN 'Advance the sales conversation: ' ELSE '' END || latest)"
        )
    )
    own = _by_domain({d: f"regexp_extract_all(text, {lit(p)})" for d, p in DOMAIN_CONSTRAINTS.items()}, "[]")
    focus = f"base + 3 * {_overlap('f1')} + CASE WHEN role = 'user' THEN 0.75 ELSE 0.0 END + pos / greatest(1, n)"
    return f"""{frame_sql(vocab)},
h AS (SELECT conv_id, turn AS cur, text AS latest, domain, intent, state, risk, pos + 1 AS n, context_chars FROM frames
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
{_fact_ctes('lf', vocab, 'SELECT conv_id AS id, latest AS text, domain FROM h')},
l8 AS (SELECT id, list(lower(v)) AS f1 FROM lf_r WHERE rk <= 8 GROUP BY id),
t0 AS (SELECT v.conv_id, v.turn, v.role, v.text, lower(v.text) AS low, h.domain, h.n, l8.f1, row_number() OVER (PARTITION BY v.conv_id ORDER BY v.turn) - 1 AS pos
  FROM (SELECT * FROM {VALID_TURNS}) v JOIN h ON h.conv_id = v.conv_id AND v.turn <= h.cur LEFT JOIN l8 ON l8.id = v.conv_id),
{score_ctes(vocab)},
{_chosen('focus', focus, f"CASE WHEN {_HIGH} THEN 8 ELSE 6 END")},
m1 AS (SELECT h.*, l8.f1, latest || chr(10) || array_to_string(list_transform(m, lambda x: x.text), chr(10)) AS text
  FROM h JOIN focus ON focus.conv_id = h.conv_id LEFT JOIN l8 ON l8.id = h.conv_id),
{_fact_ctes('ff', vocab, 'SELECT conv_id AS id, text, domain FROM m1')},
en AS (SELECT ff_r.id, list(v ORDER BY rk) AS l FROM ff_r JOIN m1 ON m1.conv_id = ff_r.id WHERE rk <= least(10, {_BUDGET.replace('domain', 'm1.domain').replace('intent', 'm1.intent')}) GROUP BY ff_r.id),
{_distinct_ctes('co', f"SELECT conv_id AS id, list_concat({_all(CONSTRAINT_PATTERNS)}, {own}) AS l FROM m1", 4)},
{_distinct_ctes('un', f"SELECT conv_id AS id, {_unresolved()} AS l FROM m1", 4)},
mem AS (SELECT m1.conv_id, cur, n, intent, state, domain, risk, f1, context_chars, {_sentence('latest')} AS task, {goal} AS user_goal,
  coalesce(en.l, []) AS entities, coalesce(co.l, []) AS constraints, coalesce(un.l, []) AS unresolved
  FROM m1 LEFT JOIN en ON en.id = m1.conv_id LEFT JOIN co ON co.id = m1.conv_id LEFT JOIN un ON un.id = m1.conv_id)"""


_LISTS = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("risk", "entities", "constraints", "unresolved"))


@query("memory_frames", f"WITH {memory_sql(TEST)} SELECT conv_id, n, intent, state, domain, task, user_goal, {_LISTS} FROM mem")
def memory(spark, path):
    m = op.memory_frames(conversations(spark, path), vocab=TEST)
    lists = [F.array_join(c, "|").alias(c) for c in ("risk", "entities", "constraints", "unresolved")]
    return m.select("conv_id", "n", "intent", "state", "domain", "task", "user_goal", *lists)


def _reasons() -> str:
    before, rest = op.RESCUED.split("{n}")
    between = rest.replace("{facts}", "")
    rescue = f"CASE WHEN len(rescue) > 0 THEN '{before}' || len(rescue) || '{between}' || array_to_string(missing[1:3], ', ') END"
    shape = (
        f"CASE WHEN len(result) = 1 THEN '{op.SUMMARY_ALONE}' "
        f"WHEN len(list_filter(result, lambda x: list_contains(recent_pos, x.pos))) > 0 THEN '{op.WITH_RECENT}' ELSE '{op.WITH_ANCHORS}' END"
    )
    return f"""CASE WHEN n <= {op.KEEP_WHOLE} THEN '{op.ALL_KEPT}' WHEN protected THEN '{op.ALL_PROTECTED}'
  ELSE concat_ws(' ', {rescue}, {shape}) END"""


def _summary_line() -> str:
    lead = "CASE " + " ".join(f"WHEN domain = {lit(d)} THEN {lit(t)}" for d, t in DOMAIN_LEADS.items()) + f" ELSE {lit(OTHER_DOMAIN_LEAD)} END"
    task = "coalesce(nullif(task, ''), nullif(user_goal, ''), 'Follow the active conversation.')"
    parts = [
        f"CASE WHEN len({c}) > 0 THEN {lit(title + ': ')} || array_to_string({c}, ', ') || '.' END"
        for title, c in (("Key facts", "entities"), ("Important constraints", "constraints"), ("Still unresolved", "unresolved"), ("Risk flags", "risk"))
    ]
    return f"concat_ws(' ', '{LABEL} summary: ' || {lead} || {task} || '.', {', '.join(parts)})"


def _tokens(messages: str) -> str:
    return f"CAST(ceil(list_sum(list_transform({messages}, lambda x: length(x.text))) / 4.0) AS BIGINT)"


_LAST_HARD = _HARD.replace("FROM src", "FROM hsrc")


def compress_sql(vocab, protect: bool = True) -> str:
    """CTEs up to res, one compressed conversation per row: result (its messages), whole, protected and all measures."""
    gate = "domain IN ('medical', 'legal') OR list_contains(risk, 'crisis')" if protect else "false"
    recent = f"base + 3 * {_overlap('all_facts')} + CASE WHEN role = 'user' THEN 0.75 ELSE 0.0 END + pos / greatest(1, n)"
    anchor = f"base + 3 * {_overlap('memory_facts')} + pos / greatest(1, n)"
    message = "{'pos': pos, 'role': role, 'text': text}"
    count = f"CASE WHEN {_HIGH} THEN 4 ELSE 2 END"
    return f"""{memory_sql(vocab)},
m2 AS (SELECT *, {gate} AS protected, list_distinct(list_transform(list_concat(entities, constraints, unresolved), lambda x: lower(x))) AS memory_facts FROM mem),
sc0 AS (SELECT sc.* EXCLUDE (domain, n, f1), m2.domain, m2.n, m2.memory_facts, list_distinct(list_concat(coalesce(m2.f1, []), m2.memory_facts)) AS all_facts
  FROM sc JOIN m2 ON m2.conv_id = sc.conv_id),
{_chosen('rc', recent, f"{count} + 2").replace('FROM sc)', 'FROM sc0)')},
rt AS (SELECT conv_id, m[greatest(1, len(m) - {count} + 1):] AS recent FROM rc),
an0 AS (SELECT *, {anchor} AS s FROM sc0),
an1 AS (SELECT an0.*, row_number() OVER (PARTITION BY an0.conv_id ORDER BY s DESC, pos DESC) AS rk FROM an0 JOIN rt ON rt.conv_id = an0.conv_id
  WHERE s >= {op.ANCHOR_SCORE} AND NOT list_contains(list_transform(recent, lambda x: x.pos), pos)),
an2 AS (SELECT conv_id, list({message} ORDER BY pos) AS l FROM an1 WHERE rk <= {op.ANCHORS} GROUP BY conv_id),
p0 AS (SELECT m2.*, recent, CASE WHEN an2.l IS NULL THEN [] ELSE {_unique('an2.l')} END AS anchors, CAST(ceil(context_chars / 4.0) AS BIGINT) AS o,
  {_summary_line()} AS line FROM m2 JOIN rt ON rt.conv_id = m2.conv_id LEFT JOIN an2 ON an2.conv_id = m2.conv_id),
p1 AS (SELECT *, [{{'pos': CAST(-1 AS BIGINT), 'role': 'assistant', 'text': line}}] AS head FROM p0),
p2 AS (SELECT *, list_concat(head, anchors, recent) AS ha, list_concat(head, recent) AS hr, list_concat(anchors, recent) AS ar FROM p1),
p3 AS (SELECT * EXCLUDE (ha, hr, ar), {_unique('ha')} AS ha, {_unique('hr')} AS hr, {_unique('ar')} AS ar FROM p2),
p4 AS (SELECT *, CASE WHEN {_tokens('ha')} / greatest(1, o) <= CASE WHEN {_HIGH} THEN 0.62 ELSE 0.5 END THEN ha
  WHEN {_tokens('hr')} / greatest(1, o) <= CASE WHEN {_HIGH} THEN 0.62 ELSE 0.5 END THEN hr ELSE head END AS first_pick FROM p3),
p5 AS (SELECT *, CASE WHEN {_tokens('first_pick')} >= o THEN ar[greatest(1, len(ar) - 3):] ELSE first_pick END AS picked FROM p4),
hsrc AS (SELECT t0.conv_id AS id, string_agg(t0.text, ' ' ORDER BY pos) AS text, any_value(t0.domain) AS domain FROM t0 JOIN m2 ON m2.conv_id = t0.conv_id
  WHERE NOT (m2.n <= {op.KEEP_WHOLE} OR protected) GROUP BY t0.conv_id),
hu AS ({_LAST_HARD}), hc AS (SELECT id, trim(r, ' ' || chr(10) || chr(9) || chr(13)) AS v, family, i FROM hu),
hk AS (SELECT *, row_number() OVER (PARTITION BY id, lower(v) ORDER BY family, i) AS rn FROM hc WHERE length(v) >= 3),
ho AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY family, i) AS rk FROM hk WHERE rn = 1),
hl AS (SELECT id, list([v] ORDER BY rk) AS vs FROM ho WHERE rk <= 20 GROUP BY id),
hf AS (SELECT id, list_reduce(vs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: contains(lower(y), lower(x[1])) AND y <> x[1])) > 0
  THEN acc ELSE list_concat(acc, x) END)[1:12] AS hard FROM hl),
p6 AS (SELECT p5.*, list_filter(coalesce(hard, []), lambda f: NOT contains(lower(array_to_string(list_transform(picked, lambda x: x.text), ' ')), lower(f))) AS missing
  FROM p5 LEFT JOIN hf ON hf.id = p5.conv_id),
rs0 AS (SELECT t0.conv_id, t0.pos, t0.role, t0.text, len(list_filter(missing, lambda f: contains(t0.low, lower(f)))) AS coverage
  FROM t0 JOIN p6 ON p6.conv_id = t0.conv_id WHERE NOT list_contains(list_transform(picked, lambda x: x.pos), t0.pos)),
rs1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coverage DESC, pos) AS rk FROM rs0 WHERE coverage > 0),
rs AS (SELECT conv_id, list({message} ORDER BY pos) AS l FROM rs1 WHERE rk <= {op.RESCUES} GROUP BY conv_id),
p7 AS (SELECT p6.*, coalesce(rs.l, []) AS rescue FROM p6 LEFT JOIN rs ON rs.conv_id = p6.conv_id),
p8 AS (SELECT *, list_concat(picked[1:1], rescue, picked[2:]) AS joined FROM p7),
p9 AS (SELECT *, CASE WHEN len(rescue) > 0 THEN {_unique('joined')} ELSE picked END AS result, list_transform(recent, lambda x: x.pos) AS recent_pos FROM p8),
res AS (SELECT *, n <= {op.KEEP_WHOLE} OR protected AS whole, {_tokens('result')} AS result_tokens,
  len(list_filter(result, lambda x: x.role <> 'assistant' OR x.text <> line)) AS retained, {_reasons()} AS kept_reasons FROM p9)"""


_FLAT = """ SELECT conv_id, domain, intent, protected, CASE WHEN whole THEN 0 ELSE greatest(0, n - retained) END AS dropped_count, o AS original_tokens,
CASE WHEN whole THEN o ELSE result_tokens END AS compressed_tokens, greatest(0, o - CASE WHEN whole THEN o ELSE result_tokens END) AS tokens_saved,
CASE WHEN whole THEN n ELSE len(result) END AS n_compressed, kept_reasons FROM res"""
_MESSAGES_SQL = """, out AS (SELECT conv_id, unnest(result) AS m, generate_subscripts(result, 1) - 1 AS out_pos FROM res WHERE NOT whole)
SELECT conv_id, out_pos, m.pos AS pos, m.role AS role, m.text AS text FROM out
UNION ALL SELECT t0.conv_id, t0.pos, t0.pos, t0.role, t0.text FROM t0 JOIN res ON res.conv_id = t0.conv_id WHERE whole"""


def flat_summary(summary):
    return summary.select(
        "conv_id", "domain", "intent", "protected", "dropped_count", "original_tokens", "compressed_tokens", "tokens_saved",
        "n_compressed", F.array_join("kept_reasons", " ").alias("kept_reasons"),
    )


@query("compress", f"WITH {compress_sql(TEST)}{_FLAT}")
def compress(spark, path):
    return flat_summary(op.compress(conversations(spark, path), vocab=TEST).summary)


@query("compressed_turns", f"WITH {compress_sql(TEST)}{_MESSAGES_SQL}")
def compressed_turns(spark, path):
    return op.compress(conversations(spark, path), vocab=TEST).turns


@query("compress_default_vocabulary", f"WITH {compress_sql(DEFAULT)}{_FLAT}")
def compress_default(spark, path):
    return flat_summary(op.compress(conversations(spark, path)).summary)


@query("compress_unprotected", f"WITH {compress_sql(TEST, protect=False)}{_FLAT}")
def compress_unprotected(spark, path):
    return flat_summary(op.compress(conversations(spark, path), protect=False, vocab=TEST).summary)


@query("compress_spread", f"WITH {compress_sql(TEST)}{_FLAT}")
def compress_spread(spark, path):
    """Segments of four turns: the form for long conversations, whose turns stay spread, on every conversation of the table."""
    return flat_summary(op.compress(conversations(spark, path), vocab=TEST, size=4).summary)


@query("compressed_turns_spread", f"WITH {compress_sql(TEST)}{_MESSAGES_SQL}")
def compressed_turns_spread(spark, path):
    return op.compress(conversations(spark, path), vocab=TEST, size=4).turns


@query(
    "handle_requests",
    f"""WITH {compress_sql(TEST)}, {route_ctes()}
SELECT res.conv_id, res.domain, res.intent, res.state, protected, md5(system_prompt) AS prompt_md5, CASE WHEN whole THEN o ELSE result_tokens END AS compressed_tokens,
kept_reasons FROM res JOIN routed ON routed.conv_id = res.conv_id AND routed.turn = res.cur""",
)
def handle_requests(spark, path):
    routed, _ = handle(conversations(spark, path), vocab=TEST)
    return routed.select(
        "conv_id", "domain", "intent", "state", "protected", F.md5("system_prompt").alias("prompt_md5"), "compressed_tokens",
        F.array_join("kept_reasons", " ").alias("kept_reasons"),
    )
