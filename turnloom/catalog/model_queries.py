"""Stand-in models for labels, summaries and embeddings, and the files that the readers and writers move."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnloom.catalog.classify_queries import FRAMES
from turnloom.catalog.data_words import TEST
from turnloom.catalog.registry import ORACLES, lit, query
from turnloom.catalog.tables import VALID_TURNS, conversations, documents, usage
from turnloom.operators import models
from turnloom.operators.classify import classify, model_context
from turnloom.operators.compress import compress_with_summary, model_summary_input
from turnloom.operators.reuse import similar_reply
from turnloom.operators.turns import valid_turns
from turnloom.session import checkpoint_dir, durable
from turnloom.sources import io

STAND_INS = ("general", "travel", "finance")


def label_model():
    """A label by the length of the text; fails on some."""

    def answer(text: str) -> tuple[str, float]:
        if len(text) % 7 == 0:
            raise ValueError(text)
        return STAND_INS[len(text) % 3], len(text) % 100 / 100

    return lambda texts: [answer(t) for t in texts]


def summary_model():
    """A summary by the length of the text; fails on some."""

    def answer(text: str) -> str:
        if len(text) % 5 == 0:
            raise ValueError(text)
        return f"{len(text)} characters of talk"

    return lambda texts: [answer(t) for t in texts]


def embedding_model():
    """A corner of the unit square by the length of the text; fails on some."""

    def answer(text: str) -> list[float]:
        if len(text) % 6 == 0:
            raise ValueError(text)
        return [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]][len(text) % 3]

    return lambda texts: [answer(t) for t in texts]


@query(
    "model_labels",
    f"""WITH c AS ({ORACLES['model_context']})
SELECT conv_id, turn, CASE WHEN length(context) % 7 > 0 THEN [{', '.join(lit(s) for s in STAND_INS)}][length(context) % 3 + 1] END AS label,
CASE WHEN length(context) % 7 > 0 THEN (length(context) % 100) / 100 END AS score FROM c""",
)
def model_labels(spark, path):
    return models.labels(model_context(conversations(spark, path)), label_model)


_INPUT = f"""{FRAMES},
lf AS (SELECT conv_id, max(turn) AS turn, arg_max(domain, turn) AS domain FROM frames GROUP BY conv_id),
ot AS (SELECT conv_id, turn, role, text FROM {VALID_TURNS} AND NOT regexp_matches(lower(text), {lit(chr(92) + 'b(' + '|'.join(TEST.distractors) + ')' + chr(92) + 'b')})),
ln AS (SELECT ot.conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(text, 300), ' ' ORDER BY ot.turn) AS lines
  FROM ot JOIN lf ON lf.conv_id = ot.conv_id AND ot.turn <= lf.turn GROUP BY ot.conv_id),
mi AS (SELECT lf.conv_id, lf.turn, domain, 'summarize: DOMAIN:' || domain || ' ' || coalesce(left(lines, 1500), '') AS model_input
  FROM lf LEFT JOIN ln ON ln.conv_id = lf.conv_id)"""


def summary_inputs(spark, path):
    turns = conversations(spark, path)
    frames = classify(turns, vocab=TEST)
    return turns, frames, model_summary_input(turns, frames, TEST)


@query("model_summary_input", f"{_INPUT} SELECT conv_id, md5(model_input) AS input_md5 FROM mi")
def summary_input(spark, path):
    return summary_inputs(spark, path)[2].select("conv_id", F.md5("model_input").alias("input_md5"))


@query(
    "compress_with_summary",
    f"""{_INPUT},
sz AS (SELECT mi.conv_id, count(*) AS n, sum(length(text)) AS chars FROM mi JOIN (SELECT * FROM {VALID_TURNS}) v ON v.conv_id = mi.conv_id AND v.turn <= mi.turn GROUP BY mi.conv_id),
wm AS (SELECT mi.conv_id, n, chars, domain, n > 4 AND length(model_input) % 5 > 0 AS by_model, CASE WHEN domain IN ('sales', 'customer_support') THEN 6 ELSE 4 END AS keep
  FROM mi JOIN sz ON sz.conv_id = mi.conv_id)
SELECT conv_id, n, CASE WHEN by_model THEN 'model' WHEN n > 4 THEN 'rule' ELSE 'whole' END AS method, CAST(ceil(chars / 4.0) AS BIGINT) AS original_tokens,
CASE WHEN by_model THEN CAST(greatest(0, n - keep) AS BIGINT) END AS dropped_by_model FROM wm""",
)
def summarised(spark, path):
    """Conversations shortened around a model's summary, by rules where the model fails. Frames and summaries are written once."""
    turns = conversations(spark, path)
    frames = durable(classify(turns, vocab=TEST))
    given = durable(models.summaries(model_summary_input(turns, frames, TEST), summary_model))
    done = compress_with_summary(turns, frames, given, TEST).summary
    dropped = F.when(F.col("method") == "model", F.col("dropped_count")).alias("dropped_by_model")
    return done.select("conv_id", "n", "method", "original_tokens", dropped)


@query(
    "model_replies",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, 'u' || (conv_id % 5) AS scope, (conv_id * 1000 + turn) * 100 AS ms, length(text) AS n FROM {VALID_TURNS} AND role = 'user' AND length(text) % 6 > 0)
SELECT q.id AS query_id, count(e.id) > 0 AS hit, min(e.id) AS match_id FROM t q LEFT JOIN t e
  ON e.scope = q.scope AND e.n % 3 = q.n % 3 AND e.id < q.id AND q.ms - e.ms <= 3600000 GROUP BY q.id""",
)
def model_replies(spark, path):
    """Reply lookup by the vectors of a model."""
    turns = valid_turns(conversations(spark, path)).filter("role = 'user'")
    asked = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string")).alias("scope"),
        ((F.col("conv_id") * 1000 + F.col("turn")) * 100).alias("at"), "text", F.length("text").cast("long").alias("reply_chars"),
    )
    return similar_reply(models.embedded(asked, "text", embedding_model)).select("query_id", "hit", "match_id")


# --- files -----------------------------------------------------------------------------------------


def folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/turnloom-files-{uuid.uuid4().hex}"


@query("cases_from_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS message_md5, 0 AS n_history, lang AS domain FROM documents")
def cases_from_jsonl(spark, path):
    """Cases written as JSON lines and read back; a missing history becomes an empty list."""
    at = folder(spark)
    rows = documents(spark, path)
    io.write_jsonl(rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("message"), F.col("lang").alias("expectedDomain")), at)
    cases = io.read_eval_cases(spark, at)
    return cases.select("id", F.md5("message").alias("message_md5"), F.size("history").alias("n_history"), F.col("expectedDomain").alias("domain"))


@query("report_files", "SELECT 'summary' AS part, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'results', source, doc_id FROM documents")
def report_files(spark, path):
    """A report's two files, read back."""
    at, rows = folder(spark), documents(spark, path)
    io.write_report(rows.groupBy("lang").agg(F.count("*").alias("n")), rows.select("source", "doc_id"), at)
    summary = spark.read.schema("lang string, n long").json(f"{at}/summary").select(F.lit("summary").alias("part"), F.col("lang").alias("name"), "n")
    results = spark.read.schema("source string, doc_id long").json(f"{at}/results")
    return summary.unionByName(results.select(F.lit("results").alias("part"), F.col("source").alias("name"), F.col("doc_id").alias("n")))


@query("usage_files", "SELECT CAST(ts AS DATE) AS call_date, count(*) AS calls, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def usage_files(spark, path):
    """Usage appended in two writes to folders by day."""
    at, rows = folder(spark), usage(spark, path)
    for rest in (0, 1):
        io.append_usage(rows.filter(F.col("id") % 2 == rest), at)
    return spark.read.parquet(at).groupBy("call_date").agg(F.count("*").alias("calls"), F.countDistinct("id").alias("ids"))


@query(
    "upserted_customers",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer
WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0""",
)
def upserted_customers(spark, path):
    """A keyed table written, then changed by updates of every third and deletes of every fifth key that is not updated."""
    at = folder(spark)
    rows = io.read_table(spark, path, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    io.upsert_table(spark, at, rows, ["id"])
    changed = rows.filter(F.col("id") % 3 == 0).withColumn("name", F.concat(F.lit("new "), "name"))
    io.upsert_table(spark, at, changed, ["id"], rows.filter((F.col("id") % 5 == 0) & (F.col("id") % 3 != 0)))
    return io.read_versioned(spark, at)


@query(
    "saas_files",
    """SELECT 'api_keys' AS part, 'key_' || c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT 'usage_log', CAST(event_id AS VARCHAR), 'key_' || user_id FROM events UNION ALL SELECT 'key_requests', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders""",
)
def saas_files(spark, path):
    """The three service tables from files; columns that a file lacks are null."""
    at = folder(spark)
    customers, orders = (io.read_table(spark, path, n) for n in ("customer", "orders"))
    customers.select(F.concat(F.lit("key_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name")).write.parquet(f"{at}/api_keys")
    usage(spark, path).select("id", "key_id").write.parquet(f"{at}/usage_log")
    orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("use_case")).write.parquet(f"{at}/key_requests")
    tables = io.read_saas_tables(spark, at)
    named = {"api_keys": "name", "usage_log": "key_id", "key_requests": "use_case"}
    parts = [tables[t].select(F.lit(t).alias("part"), F.col("id").cast("string").alias("id"), F.col(c).alias("name")) for t, c in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
