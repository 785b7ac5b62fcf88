"""Log text and labelled evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.compress_queries import compress_sql
from turnloom.catalog.registry import lit, query
from turnloom.catalog.tables import conversations, documents
from turnloom.functions.vocab import DEFAULT
from turnloom.operators import evals, logs
from turnloom.sources.io import read_table

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


@query(
    "line_runs",
    f"""WITH {_LINES}, c AS (SELECT *, CASE WHEN lag(line) OVER w = line THEN 0 ELSE 1 END AS ch FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(line_no) AS first_line, md5(min(line)) AS line_md5, count(*) AS n_lines FROM r GROUP BY doc_id, run""",
)
def line_runs(spark, path):
    return logs.line_runs(documents(spark, path)).select("doc_id", "run", "first_line", F.md5("line").alias("line_md5"), "n_lines")


_STACKY = "replace(replace(text, '. ', chr(10) || '  at '), ', ', chr(10))"


@query(
    "stack_runs",
    f"""WITH l AS (SELECT doc_id, unnest(string_split({_STACKY}, chr(10))) AS line, generate_subscripts(string_split({_STACKY}, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l WHERE regexp_matches(line, '^\\s*at ')
  OR contains(line, 'Traceback ') OR contains(line, 'node_modules') OR contains(line, 'File "'))
SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines FROM s GROUP BY doc_id, run""",
)
def stack_runs(spark, path):
    return logs.stack_runs(stacky(documents(spark, path)))


def stacky(docs):
    text = F.replace(F.replace("text", F.lit(". "), F.lit("\n  at ")), F.lit(", "), F.lit("\n"))
    return docs.withColumn("text", text)


def compaction_sql(source: str) -> str:
    """CTEs up to z(doc_id, text, compacted) over source(doc_id, text): a walk over the lines that jumps over repeated blocks,
    then the middles of runs of stack lines, images and long lines."""
    return f"""WITH RECURSIVE src AS ({source}), a AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM src),
e AS (SELECT doc_id, s, i FROM a, range(1, {logs.MAX_BLOCK + 1}) AS ss(s), unnest(range(1, len(l) - 2 * s + 2)) AS ii(i)
  WHERE l[i] = l[i + s] AND l[i:i + s - 1] = l[i + s:i + 2 * s - 1] AND len(list_filter(l[i:i + s - 1], lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0),
g AS (SELECT *, i // s - row_number() OVER (PARTITION BY doc_id, s, i % s ORDER BY i) AS run FROM e),
c AS (SELECT doc_id, s, i, (max(i) OVER (PARTITION BY doc_id, s, i % s, run) - i) // s + 1 AS n FROM g),
j AS (SELECT doc_id, i, arg_min(s, s) AS s, arg_min(n, s) AS n FROM c WHERE n > 1 GROUP BY doc_id, i),
w AS (SELECT doc_id, CAST(1 AS BIGINT) AS i FROM a UNION ALL
  SELECT w.doc_id, w.i + coalesce(j.s * (j.n + 1), 1) FROM w JOIN a ON a.doc_id = w.doc_id LEFT JOIN j ON j.doc_id = w.doc_id AND j.i = w.i
  WHERE w.i + coalesce(j.s * (j.n + 1), 1) <= len(a.l)),
o AS (SELECT w.doc_id, w.i, unnest(CASE WHEN j.s IS NULL THEN [a.l[w.i]] ELSE
    list_append(a.l[w.i:w.i + j.s - 1], '... [' || j.n || ' IDENTICAL BLOCKS COMPRESSED BY CTX] ...') END) AS line,
  generate_subscripts(CASE WHEN j.s IS NULL THEN [1] ELSE range(j.s + 1) END, 1) AS k
  FROM w JOIN a ON a.doc_id = w.doc_id LEFT JOIN j ON j.doc_id = w.doc_id AND j.i = w.i),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos, regexp_matches(line, '^\\s*at ') OR contains(line, 'Traceback ')
  OR contains(line, 'node_modules') OR contains(line, 'File "') AS st FROM o),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, st ORDER BY pos) AS run FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, st, run ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id, st, run) AS size FROM r),
k AS (SELECT doc_id, pos, CASE WHEN st AND size > 6 AND nth = 4 THEN '... [' || (size - 6) || ' STACK TRACE LINES COMPRESSED BY CTX] ...' ELSE line END AS line
  FROM m WHERE NOT st OR size <= 6 OR nth <= 4 OR nth > size - 3),
f AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM k GROUP BY doc_id),
z AS (SELECT a.doc_id, a.text, array_to_string(list_transform(string_split(regexp_replace(t, 'data:image/[a-zA-Z]*;base64,[A-Za-z0-9+/=]+', '[BASE64_IMAGE_REMOVED]', 'g'), chr(10)),
  lambda x: CASE WHEN length(x) > 300 THEN left(x, 150) || ' ... [LONG LINE OF ' || length(x) || ' CHARS TRUNCATED] ... ' || right(x, 50) ELSE x END), chr(10)) AS compacted
  FROM f JOIN a ON a.doc_id = f.doc_id)"""


@query(
    "log_compaction",
    compaction_sql(f"SELECT doc_id, {_STACKY} AS text FROM documents")
    + " SELECT doc_id, length(text) AS n_before, length(compacted) AS n_after, md5(compacted) AS compacted_md5 FROM z",
)
def log_compaction(spark, path):
    out = logs.compact_logs(stacky(documents(spark, path)))
    return out.select("doc_id", F.length("text").cast("long").alias("n_before"), F.length("compacted").cast("long").alias("n_after"), F.md5("compacted").alias("compacted_md5"))


@query(
    "digest_logs",
    compaction_sql("SELECT doc_id, text FROM documents")
    + f""", d AS (SELECT z.doc_id, z.text, CASE WHEN len(string_split(compacted, ' ')) < {logs.MODEL_WORDS} AND z.doc_id % 3 > 0 THEN 'Log of source ' || source
  ELSE left(compacted, {logs.OUTPUT_CHARS}) END AS digest FROM z JOIN documents USING (doc_id)),
t AS (SELECT *, CAST(ceil(length(text) / 4.1) AS BIGINT) AS o, CAST(ceil(length(digest) / 4.1) AS BIGINT) AS c FROM d)
SELECT doc_id, md5(digest) AS digest_md5, o AS original_tokens, c AS compressed_tokens, greatest(0, o - c) AS saved_tokens,
CASE WHEN o > 0 THEN round(greatest(0, o - c) / o * 100) ELSE 0.0 END AS savings_pct FROM t""",
)
def digest_logs(spark, path):
    summary = F.concat(F.lit("Log of source "), "source")
    out = logs.digest_logs(documents(spark, path).withColumn("summary", F.when(F.col("doc_id") % 3 > 0, summary)), "summary")
    return out.select("doc_id", F.md5("digest").alias("digest_md5"), "original_tokens", "compressed_tokens", "saved_tokens", "savings_pct")


_TYPES = [*evals.LEGACY_LABELS, "information_seeking", "unknown"]


def legacy_sql(variant: str) -> str:
    convert = variant == "convert"
    intents = evals.CONVERT_INTENTS if convert else evals.EVAL_INTENTS
    labels = dict(evals.LEGACY_LABELS)
    if convert:
        labels["information_seeking"] = ("information_seeking", None)

    def pick(rules, default):
        return "CASE " + " ".join(f"WHEN regexp_matches(low, {lit(p)}) THEN {lit(x)}" for p, x in rules) + f" ELSE {lit(default)} END"

    def domain(name):
        rules = evals.PROBLEM_DOMAINS if convert else evals.EVAL_DOMAINS
        if convert and name in ("comparison", "decision_support"):
            rules = evals.COMPARISON_DOMAINS if name == "comparison" else evals.DECISION_DOMAINS
        return pick(rules, "general")

    i = " ".join(
        f"WHEN kind = {lit(n)} THEN {pick(intents[n], evals.OTHER_INTENT[n]) if a == '?' else lit(a)}" for n, (a, _) in labels.items()
    )
    d = " ".join(f"WHEN kind = {lit(n)} THEN {lit(b) if b else domain(n)}" for n, (_, b) in labels.items())
    kinds = "[" + ", ".join(lit(k) for k in _TYPES) + f"][1 + doc_id % {len(_TYPES)}]"
    return f"""x AS (SELECT doc_id, {kinds} AS kind, lower(text || chr(10)) AS low FROM documents),
m AS (SELECT doc_id, kind, CASE {i} ELSE 'task_execution' END AS intent, CASE {d} ELSE {domain('')} END AS domain FROM x)"""


def legacy_cases(spark, path):
    kinds = F.array(*[F.lit(k) for k in _TYPES])
    return documents(spark, path).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("message"),
        F.array().cast("array<struct<role:string,content:string,timestamp:string>>").alias("history"),
        F.get(kinds, (F.col("doc_id") % len(_TYPES)).cast("int")).alias("expectedType"),
        F.lit("opening").alias("expectedState"),
        F.array(F.lit("crisis"), F.lit("nonsense"), F.lit("legal_caution")).alias("expectedRisk"),
        F.lit(None).cast("string").alias("notes"),
    )


@query(
    "convert_legacy",
    f"""WITH {legacy_sql('convert')} SELECT CAST(doc_id AS VARCHAR) AS id, intent AS "expectedIntent", domain AS "expectedDomain",
'crisis|legal_caution' || CASE WHEN kind = 'crisis' THEN '|protected_context' ELSE '' END AS risk FROM m""",
)
def convert_legacy(spark, path):
    out = evals.convert_legacy(legacy_cases(spark, path))
    return out.select("id", "expectedIntent", "expectedDomain", F.array_join("expectedRisk", "|").alias("risk"))


@query(
    "label_distribution",
    f"""WITH {legacy_sql('convert')} SELECT 'intent' AS dimension, intent AS label, count(*) AS n FROM m GROUP BY intent
UNION ALL SELECT 'domain', domain, count(*) FROM m GROUP BY domain""",
)
def label_distribution(spark, path):
    return evals.label_distribution(evals.convert_legacy(legacy_cases(spark, path)))


@query("expected_labels", f"WITH {legacy_sql('eval')} SELECT CAST(doc_id AS VARCHAR) AS id, intent AS x_intent, domain AS x_domain FROM m")
def expected_labels(spark, path):
    cases = legacy_cases(spark, path).withColumns(
        {
            "expectedIntent": F.lit(None).cast("string"),
            "expectedDomain": F.lit(None).cast("string"),
            "mustKeep": F.lit(None).cast("array<string>"),
            "shouldDrop": F.lit(None).cast("array<string>"),
            "expectedMinSavingsPct": F.lit(None).cast("double"),
        }
    )
    return evals.expected_labels(cases).select("id", "x_intent", "x_domain")


@query(
    "eval_scorecard",
    """WITH j AS (SELECT d.doc_id, d.text, replace(d.text, ' of ', ' ') AS short, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS o, CAST(ceil(length(short) / 4.0) AS BIGINT) AS c FROM j),
p AS (SELECT *, (quality = 1) = (o >= 100) AS pi, (toxic = 1) = (doc_id % 5 = 0) AS pd, contains(lower(short), 'the') AND contains(lower(short), 'an') AS pk,
  NOT regexp_matches(short, '(?i)\\bof\\b') AS ps, (o - c) / o * 100 >= 1 AS pv FROM n)
SELECT count(*) AS total, avg(CAST(pi AND pd AND pk AND ps AND pv AS INTEGER)) AS all_rate, avg(CAST(pi AS INTEGER)) AS intent_rate, avg(CAST(pd AS INTEGER)) AS domain_rate,
  avg(CAST(pk AS INTEGER)) AS must_keep_rate, avg(CAST(ps AS INTEGER)) AS should_drop_rate, avg(CAST(pv AS INTEGER)) AS savings_rate,
  CAST(sum(o) AS BIGINT) AS total_original_tokens, CAST(sum(c) AS BIGINT) AS total_compressed_tokens, CAST(sum(o - c) AS BIGINT) AS total_tokens_saved,
  sum(o - c) / sum(o) AS token_savings_ratio, count(*) FILTER (WHERE NOT (pi AND pd AND pk AND ps AND pv)) AS value_failures FROM p""",
)
def eval_scorecard(spark, path):
    joined = documents(spark, path).join(read_table(spark, path, "labels"), "doc_id")
    joined = joined.withColumn("short", F.replace("text", F.lit(" of "), F.lit(" ")))
    o, c = F.ceil(F.length("text") / 4), F.ceil(F.length("short") / 4)
    none = F.array().cast("array<string>")
    rows = joined.select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("x_intent"),
        F.when(o >= 100, "good").otherwise("bad").alias("intent"),
        F.when(F.col("toxic") == 1, "t").otherwise("f").alias("x_domain"),
        F.when(F.col("doc_id") % 5 == 0, "t").otherwise("f").alias("domain"),
        F.lit("opening").alias("x_state"),
        F.lit("opening").alias("state"),
        none.alias("x_risk"),
        none.alias("risk"),
        F.array(F.lit("the"), F.lit("an")).alias("must_keep"),
        F.array(F.lit("of")).alias("should_drop"),
        F.lit(1.0).alias("min_savings_pct"),
        F.col("short").alias("compressed_text"),
        o.alias("original_tokens"),
        c.alias("compressed_tokens"),
        (o - c).alias("tokens_saved"),
    )
    flags = ("all", "intent", "domain", "must_keep", "should_drop", "savings")
    return evals.scorecard(evals.score_cases(rows), flags).drop("strict_failures")


def conversation_cases(spark, path):
    """Conversations as evaluation cases: the last user turn is the message."""
    from turnloom.operators.turns import request_rows

    rows = request_rows(conversations(spark, path)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l")
    )
    past = F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return rows.select(
        F.col("conv_id").cast("string").alias("id"),
        F.element_at("l", -1)["text"].alias("message"),
        past.alias("history"),
        F.lit("task_execution").alias("expectedIntent"),
        F.lit("general").alias("expectedDomain"),
        F.lit(None).cast("string").alias("expectedState"),
        F.lit(None).cast("array<string>").alias("expectedRisk"),
        F.lit(None).cast("string").alias("expectedType"),
        F.array(F.lit("the")).alias("mustKeep"),
        F.array(F.lit("und")).alias("shouldDrop"),
        F.lit(30.0).alias("expectedMinSavingsPct"),
        F.lit(None).cast("string").alias("notes"),
    )


_CASES = f"""WITH {compress_sql(DEFAULT, protect=False)},
ct AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY pos) AS all_text FROM t0 GROUP BY conv_id),
v AS (SELECT res.*, CASE WHEN whole THEN all_text ELSE array_to_string(list_transform(result, lambda x: x.text), chr(10)) END AS short,
  CASE WHEN whole THEN o ELSE result_tokens END AS c FROM res JOIN ct ON ct.conv_id = res.conv_id),
x AS (SELECT CAST(conv_id AS VARCHAR) AS id, intent, domain, state, o AS original_tokens, c AS compressed_tokens, greatest(0, o - c) AS saved,
  intent = 'task_execution' AS pass_intent, domain = 'general' AS pass_domain, state = 'opening' AS pass_state, len(risk) = 0 AS pass_risk,
  contains(lower(short), 'the') AS pass_must_keep, NOT regexp_matches(short, '(?i)\\bund\\b') AS pass_should_drop,
  CASE WHEN o = 0 THEN 0 ELSE greatest(0, o - c) / o * 100 END >= 30 AS pass_savings FROM v),
y AS (SELECT *, pass_must_keep AND pass_should_drop AND pass_savings AS pass_quality FROM x),
z AS (SELECT *, pass_intent AND pass_domain AND pass_quality AS pass_value FROM y)"""


@query(
    "evaluate",
    f"""{_CASES} SELECT id, intent, domain, state, original_tokens, compressed_tokens, pass_value AND pass_state AND pass_risk AS pass_all, pass_intent, pass_domain,
pass_state, pass_risk, pass_must_keep, pass_should_drop, pass_savings, pass_quality, pass_value FROM z""",
)
def evaluate(spark, path):
    out = evals.evaluate(conversation_cases(spark, path))
    return out.select("id", "intent", "domain", "state", "original_tokens", "compressed_tokens", *[f"pass_{f}" for f in evals.PASS_FLAGS])


@query(
    "route_savings",
    f"""{_CASES} SELECT count(*) FILTER (WHERE pass_intent AND pass_domain) AS route_passes, count(*) AS cases, CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
CAST(sum(saved) AS BIGINT) AS tokens_saved, CASE WHEN sum(original_tokens) = 0 THEN 0.0 ELSE sum(saved) / sum(original_tokens) END AS savings_ratio FROM z""",
)
def route_savings(spark, path):
    return evals.route_savings(conversation_cases(spark, path))
