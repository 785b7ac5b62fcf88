"""Payload parsing, vectors, sessions and rates over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.registry import query
from turnloom.catalog.tables import VALID_TURNS, conversations, documents
from turnloom.functions.text import cosine
from turnloom.operators.compress import fallback_rate as rate
from turnloom.operators.turns import valid_turns
from turnloom.sources import io
from turnloom.streaming.limits import sessions


@query(
    "cosine",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_of_neighbours(spark, path):
    a = io.read_table(spark, path, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "parse_source",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'note ' || doc_id ELSE '' END AS title, md5(CASE WHEN doc_id % 3 < 2 THEN text ELSE '' END) AS content_md5 FROM documents""",
)
def parse_source(spark, path):
    """Payloads with both fields, with the content only, and broken ones."""
    both = F.to_json(F.struct(F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content")))
    payload = F.when(F.col("doc_id") % 3 == 0, both).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.lit("{broken"))
    parsed = documents(spark, path).select("doc_id", io.parse_source(payload).alias("s"))
    return parsed.select("doc_id", F.col("s.title").alias("title"), F.md5("s.content").alias("content_md5"))


@query(
    "parse_messages",
    """SELECT conv_id, turn, CAST(CASE WHEN role IN ('user', 'assistant') AND text IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n,
coalesce(md5(CASE WHEN role IN ('user', 'assistant') THEN text END), '') AS text_md5 FROM conversations""",
)
def parse_messages(spark, path):
    item = F.struct("role", F.col("text").alias("content"))
    payload = F.to_json(F.array(item, F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content"))))
    rows = conversations_of_all_roles(spark, path).select("conv_id", "turn", io.parse_messages(payload).alias("m"))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.coalesce(F.md5(F.get("m", 0)["content"]), F.lit("")).alias("text_md5"))


def conversations_of_all_roles(spark, path):
    return io.read_table(spark, path, "conversations").select("conv_id", "turn", "role", "text")


@query(
    "parse_plugins",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || '|' || source END AS keywords FROM documents""",
)
def parse_plugins(spark, path):
    """Plugins of one item; those with a missing field are dropped."""
    fields = [F.col("source").alias("id"), F.col("lang").alias("label"), F.array("lang", "source").alias("keywords"), F.lit("b").alias("behavior")]
    whole = F.to_json(F.array(F.struct(*fields, F.lit("c").alias("constraints"))))
    part = F.to_json(F.array(F.struct(*fields)))
    rows = documents(spark, path).select("doc_id", io.parse_plugins(F.when(F.col("doc_id") % 4 == 0, part).otherwise(whole)).alias("p"))
    return rows.select("doc_id", F.coalesce(F.array_join(F.get("p", 0)["keywords"], "|"), F.lit("")).alias("keywords"))


@query(
    "session_boundaries",
    """WITH e AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR
  OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS s FROM e)
SELECT conv_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn
FROM s GROUP BY conv_id, s""",
)
def session_boundaries(spark, path):
    events = io.read_table(spark, path, "events")
    turns = events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions(turns, "6 hours")


@query(
    "fallback_rate",
    f"""WITH m AS (SELECT conv_id, conv_id % 4 AS k FROM {VALID_TURNS} GROUP BY conv_id)
SELECT count(*) FILTER (WHERE k < 3) AS requests, count(*) FILTER (WHERE k = 0) AS successes, count(*) FILTER (WHERE k IN (1, 2)) AS fallbacks,
count(*) FILTER (WHERE k IN (1, 2)) / count(*) FILTER (WHERE k < 3) AS fallback_rate FROM m""",
)
def fallback_rate(spark, path):
    method = F.when(F.col("conv_id") % 4 == 0, "model").when(F.col("conv_id") % 4 < 3, "rule").otherwise("whole")
    return rate(valid_turns(conversations(spark, path)).select("conv_id").distinct().withColumn("method", method))
