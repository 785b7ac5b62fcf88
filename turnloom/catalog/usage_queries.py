"""Usage reporting, keys, waitlist, rate limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.registry import query
from turnloom.catalog.tables import KEYS_SQL, NOW, REQUESTS_SQL, USAGE_SQL, api_keys, key_requests, usage
from turnloom.operators import usage as op

_NOW = f"TIMESTAMP '{NOW}'"
_DASH = f"""
WITH u AS ({USAGE_SQL}), k AS ({KEYS_SQL}),
d AS (SELECT k.*, count(u.id) AS total_calls, CAST(coalesce(sum(u.tokens_saved), 0) AS BIGINT) AS total_tokens_saved,
  count(u.id) FILTER (WHERE u.called_at >= {_NOW} - INTERVAL 24 HOUR) AS last24h_calls
  FROM k LEFT JOIN u ON u.key_id = k.id GROUP BY ALL)
"""


def now():
    return F.lit(NOW).cast("timestamp")


def dashboard(spark, path):
    return op.key_dashboard(api_keys(spark, path), usage(spark, path), now(), derive_quota=True)


@query("key_dashboard", f"{_DASH} SELECT id, name, active, created_at, total_calls, total_tokens_saved, last24h_calls FROM d")
def key_dashboard(spark, path):
    return op.newest_first(dashboard(spark, path), "created_at", "id").select(
        "id", "name", "active", "created_at", "total_calls", "total_tokens_saved", "last24h_calls"
    )


@query(
    "own_usage",
    f"""WITH u AS ({USAGE_SQL}) SELECT count(*) AS total_calls, CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS total_tokens_saved,
count(*) FILTER (WHERE called_at >= {_NOW} - INTERVAL 24 HOUR) AS last24h_calls FROM u WHERE key_id = 'key_7'""",
)
def own_usage(spark, path):
    return op.own_usage(usage(spark, path), "key_7", now())


@query(
    "usage_by_key",
    f"""WITH u AS ({USAGE_SQL}) SELECT key_id, count(*) AS total_calls, CAST(sum(tokens_saved) AS BIGINT) AS total_tokens_saved,
count(*) FILTER (WHERE called_at >= {_NOW} - INTERVAL 24 HOUR) AS last24h_calls FROM u GROUP BY key_id""",
)
def usage_by_key(spark, path):
    return op.usage_by_key(usage(spark, path), now())


@query(
    "dashboard_kpis",
    f"""{_DASH} SELECT count(*) AS keys, count(*) FILTER (WHERE active) AS active_keys, CAST(sum(last24h_calls) AS BIGINT) AS calls_24h,
CAST(sum(total_tokens_saved) AS BIGINT) AS tokens_saved FROM d""",
)
def dashboard_kpis(spark, path):
    return op.dashboard_kpis(dashboard(spark, path))


@query(
    "quota_utilisation",
    f"""{_DASH}, q AS (SELECT id, total_calls AS quota_used, quota_limit,
  CAST(CASE WHEN quota_limit > 0 THEN least(100, round(total_calls / quota_limit * 100)) ELSE 0 END AS BIGINT) AS quota_pct FROM d)
SELECT id, quota_used, quota_pct, CASE WHEN quota_pct >= 90 THEN 'full' WHEN quota_pct >= 70 THEN 'warn' ELSE '' END AS quota_level FROM q""",
)
def quota_utilisation(spark, path):
    return op.quota_utilisation(dashboard(spark, path)).select("id", "quota_used", "quota_pct", "quota_level")


@query(
    "recent_usage",
    f"""WITH u AS ({USAGE_SQL}) SELECT key_id, id, endpoint, called_at FROM
(SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY called_at DESC, id DESC) AS rn FROM u) WHERE rn <= 10""",
)
def recent_usage(spark, path):
    return op.recent_usage(usage(spark, path), 10).select("key_id", "id", "endpoint", "called_at")


@query("waitlist_count", f"WITH r AS ({REQUESTS_SQL}) SELECT count(*) AS waiting FROM r WHERE fulfilled_at IS NULL")
def waitlist_count(spark, path):
    return op.waitlist_count(key_requests(spark, path))


@query(
    "waitlist_position",
    f"""WITH r AS ({REQUESTS_SQL}), e AS (SELECT DISTINCT email FROM r), t AS (SELECT count(*) AS n FROM r WHERE fulfilled_at IS NULL),
o AS (SELECT email, count(*) AS n FROM r WHERE fulfilled_at IS NULL GROUP BY email)
SELECT e.email, t.n - coalesce(o.n, 0) + 1 AS position FROM e CROSS JOIN t LEFT JOIN o ON o.email = e.email""",
)
def waitlist_position(spark, path):
    return op.waitlist_position(key_requests(spark, path))


@query("newest_requests", f"WITH r AS ({REQUESTS_SQL}) SELECT id, email, use_case, requested_at, fulfilled_at FROM r")
def newest_requests(spark, path):
    return op.newest_requests(key_requests(spark, path))


def calls(spark, path):
    u = usage(spark, path)
    return u.withColumn("raw_key", F.concat(F.lit("raw-"), F.substring("key_id", 5, 20)))


@query(
    "resolve_key",
    f"WITH u AS ({USAGE_SQL}), k AS ({KEYS_SQL}) SELECT u.id AS call_id, k.id, k.name FROM u JOIN k ON k.key_hash = sha256('raw-' || u.key_id[5:]) WHERE k.active",
)
def resolve_key(spark, path):
    out = op.resolve_key(calls(spark, path).withColumnRenamed("id", "call_id").drop("key_id"), api_keys(spark, path))
    return out.select("call_id", "id", "name")


@query(
    "last_used",
    f"WITH u AS ({USAGE_SQL}), k AS ({KEYS_SQL}) SELECT k.id, max(u.called_at) AS last_used_at FROM u JOIN k ON k.id = u.key_id WHERE k.active GROUP BY k.id",
)
def last_used(spark, path):
    return op.last_used(calls(spark, path).select("raw_key", "called_at"), api_keys(spark, path))


@query(
    "usage_report",
    f"""{_DASH}, r AS ({REQUESTS_SQL}), q AS (SELECT id, CAST(CASE WHEN quota_limit > 0 THEN least(100, round(total_calls / quota_limit * 100)) ELSE 0 END AS BIGINT) AS pct FROM d),
t AS (SELECT count(*) AS n FROM r WHERE fulfilled_at IS NULL), o AS (SELECT email, count(*) AS n FROM r WHERE fulfilled_at IS NULL GROUP BY email)
SELECT 'dashboard' AS section, id AS item, pct AS value FROM q
UNION ALL SELECT 'kpis', 'active_keys', count(*) FILTER (WHERE active) FROM d
UNION ALL SELECT 'kpis', 'calls_24h', CAST(sum(last24h_calls) AS BIGINT) FROM d
UNION ALL SELECT 'kpis', 'keys', count(*) FROM d
UNION ALL SELECT 'kpis', 'tokens_saved', CAST(sum(total_tokens_saved) AS BIGINT) FROM d
UNION ALL SELECT 'recent', key_id, id FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY called_at DESC, id DESC) AS rn FROM u) WHERE rn <= 100
UNION ALL SELECT 'waitlist', 'waiting', n FROM t
UNION ALL SELECT 'positions', e.email, t.n - coalesce(o.n, 0) + 1 FROM (SELECT DISTINCT email FROM r) e CROSS JOIN t LEFT JOIN o ON o.email = e.email
UNION ALL SELECT 'requests', email, id FROM r""",
)
def usage_report(spark, path):
    """The whole report in long form."""
    report = op.usage_report(api_keys(spark, path), usage(spark, path), key_requests(spark, path), now())
    kpis = report["kpis"].select(F.explode(F.create_map(*[x for c in ("keys", "active_keys", "calls_24h", "tokens_saved") for x in (F.lit(c), F.col(c).cast("long"))])).alias("item", "value"))
    parts = {
        "dashboard": report["dashboard"].select(F.col("id").alias("item"), F.col("quota_pct").alias("value")),
        "kpis": kpis,
        "recent": report["recent"].select(F.col("key_id").alias("item"), F.col("id").alias("value")),
        "waitlist": report["waitlist"].select(F.lit("waiting").alias("item"), F.col("waiting").alias("value")),
        "positions": report["positions"].select(F.col("email").alias("item"), F.col("position").alias("value")),
        "requests": report["requests"].select(F.col("email").alias("item"), F.col("id").alias("value")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("section"), "item", F.col("value").cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "usage_rollup",
    f"""WITH u AS ({USAGE_SQL}), e AS (SELECT key_id, tokens_saved, date_trunc('hour', called_at) - to_hours(CAST(i AS INTEGER)) AS window_start
  FROM u, range(24) AS r(i))
SELECT key_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS calls, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved
FROM e GROUP BY key_id, window_start""",
)
def usage_rollup(spark, path):
    return op.usage_rollup(usage(spark, path))


_W = 6 * 3600 * 1000


@query(
    "rate_limit",
    f"""
WITH RECURSIVE u AS ({USAGE_SQL}), e AS (SELECT key_id, id AS call_id, called_at, epoch_us(called_at) // 1000 AS ms FROM u),
s(key_id, start) AS (SELECT key_id, min(ms) FROM e GROUP BY key_id
  UNION ALL SELECT s.key_id, min(e.ms) FROM s JOIN e ON e.key_id = s.key_id AND e.ms > s.start + {_W} GROUP BY s.key_id, s.start),
w AS (SELECT e.key_id, e.call_id, e.called_at, max(s.start) AS start, e.ms FROM e JOIN s ON s.key_id = e.key_id AND s.start <= e.ms GROUP BY ALL)
SELECT key_id, call_id, called_at, make_timestamp(start * 1000) AS window_start,
  row_number() OVER (PARTITION BY key_id, start ORDER BY ms, call_id) <= 3 AS allowed FROM w
""",
)
def rate_limit(spark, path):
    u = usage(spark, path).withColumnRenamed("id", "call_id")
    return op.rate_limit(u.select("key_id", "call_id", "called_at"), 3, _W)


@query(
    "rate_limit_per_minute",
    f"WITH u AS ({USAGE_SQL}) SELECT key_id, count(*) AS calls, count(*) AS allowed FROM u GROUP BY key_id",
)
def rate_limit_per_minute(spark, path):
    u = usage(spark, path).withColumnRenamed("id", "call_id")
    judged = op.rate_limit(u.select("key_id", "call_id", "called_at"))
    return judged.groupBy("key_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed"))
