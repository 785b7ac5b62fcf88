"""Reply reuse over the supplied embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.registry import query
from turnloom.catalog.tables import vectors
from turnloom.operators import reuse as op

THRESHOLD = 0.3
TTL = 3_600_000

_MATCH = f"""
WITH v AS (SELECT vec_id AS id, 'general::' || label AS scope, vec_id * 60000 AS at, CAST(embedding AS DOUBLE[]) AS e,
  40 + vec_id % 200 AS chars, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
p AS (SELECT q.id, c.id AS cid, c.chars, list_dot_product(q.e, c.e) AS sim FROM v q JOIN v c
  ON c.scope = q.scope AND c.pos < q.pos AND q.at - c.at <= {TTL}),
b AS (SELECT id, cid, chars, round(sim, 12) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, cid) = 1),
r AS (SELECT v.id AS query_id, coalesce(b.sim >= {THRESHOLD}, false) AS hit, b.cid, b.sim, b.chars FROM v LEFT JOIN b ON b.id = v.id)
"""


def lookups(spark, path):
    return op.similar_reply(vectors(spark, path), THRESHOLD, TTL)


@query(
    "similar_reply",
    f"""{_MATCH} SELECT query_id, hit, CASE WHEN hit THEN cid END AS match_id, CASE WHEN hit THEN round(sim, 3) END AS similarity,
CASE WHEN hit THEN CAST(round(chars / 4) AS BIGINT) END AS saved_tokens FROM r""",
)
def similar_reply(spark, path):
    return lookups(spark, path)


@query(
    "cache_stats",
    f"""{_MATCH} SELECT count(*) FILTER (WHERE hit) AS total_hits, count(*) FILTER (WHERE NOT hit) AS total_misses,
count(*) FILTER (WHERE hit) / count(*) AS hit_rate, CAST(coalesce(sum(round(chars / 4)) FILTER (WHERE hit), 0) AS BIGINT) AS tokens_saved,
(SELECT count(*) FROM v WHERE 30000000 - v."at" <= 20000000) AS total_entries FROM r""",
)
def cache_stats(spark, path):
    return op.cache_stats(lookups(spark, path), op.lru_keep(entries(spark, path), F.lit(30_000_000), 20_000_000, None))


def entries(spark, path):
    v = vectors(spark, path)
    return v.select(
        F.col("query_id").alias("entry_id"),
        "scope",
        F.col("at").alias("last_hit"),
        F.concat(F.lit("s"), (F.col("query_id") % 7).cast("string")).alias("session_id"),
    )


@query(
    "lru_keep",
    """WITH v AS (SELECT vec_id AS entry_id, 'general::' || label AS scope, vec_id * 60000 AS last_hit FROM embeddings),
l AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY last_hit DESC, entry_id) AS rn FROM v WHERE 30000000 - last_hit <= 20000000)
SELECT entry_id, scope, last_hit FROM l WHERE rn <= 20""",
)
def lru_keep(spark, path):
    return op.lru_keep(entries(spark, path), F.lit(30_000_000), 20_000_000, 20).select("entry_id", "scope", "last_hit")


@query("clear_session", "SELECT vec_id AS entry_id, 's' || (vec_id % 7) AS session_id FROM embeddings WHERE vec_id % 7 NOT IN (2, 5)")
def clear_session(spark, path):
    gone = entries(spark, path).filter(F.col("entry_id") % 7 == 2).unionByName(entries(spark, path).filter(F.col("entry_id") % 7 == 5))
    return op.clear_session(entries(spark, path), gone).select("entry_id", "session_id")


_ENTRY = "STRUCT(id BIGINT, chars BIGINT, ms BIGINT)[]"
_LIVE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, 'general::' || label AS scope, vec_id * 60000 AS ms, CAST(embedding AS DOUBLE[]) AS e,
  CAST(40 + vec_id % 200 AS BIGINT) AS chars, label <> 3 AS storable, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
s AS (SELECT q.id, c.id AS cid, list_dot_product(q.e, c.e) AS sim FROM v q JOIN v c ON c.scope = q.scope AND c.k < q.k),
m AS (SELECT id, list({{'cid': cid, 'sim': sim}} ORDER BY sim DESC, cid) AS m FROM s WHERE sim >= {THRESHOLD} GROUP BY id),
q AS (SELECT v.id, scope, ms, chars, storable, k, m.m FROM v LEFT JOIN m ON m.id = v.id),
r AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cid, CAST(NULL AS DOUBLE) AS sim,
    CAST(NULL AS BIGINT) AS chars, CAST([] AS {_ENTRY}) AS st FROM v
  UNION ALL SELECT scope, k, id, b.cid, b.sim, list_filter(live, lambda x: x.id = b.cid)[1].chars,
    CASE WHEN b IS NOT NULL THEN list_transform(live, lambda x: {{'id': x.id, 'chars': x.chars, 'ms': CASE WHEN x.id = b.cid THEN ms ELSE x.ms END}})
      WHEN storable AND chars >= 50 THEN list_append(live, {{'id': id, 'chars': chars, 'ms': ms}}) ELSE live END
  FROM (SELECT *, list_filter(m, lambda y: list_contains(list_transform(live, lambda x: x.id), y.cid))[1] AS b
    FROM (SELECT q.*, list_filter(r.st, lambda x: q.ms - x.ms <= {TTL}) AS live FROM r JOIN q ON q.scope = r.scope AND q.k = r.k + 1)))
SELECT scope, id AS query_id, cid IS NOT NULL AS hit, cid AS match_id, round(sim, 3) AS similarity, CAST(round(chars / 4) AS BIGINT) AS saved_tokens
FROM r WHERE k > 0"""


@query("reply_reuse", _LIVE_SQL)
def reply_reuse(spark, path):
    return op.reply_reuse(vectors(spark, path), THRESHOLD, TTL, 500, 50)
