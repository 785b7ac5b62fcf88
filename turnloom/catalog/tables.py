"""The supplied tables in the shape the operators expect, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.io import read_table

NOW = "2024-01-31 00:00:00"
VALID_TURNS = "conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL"


def spread(df: DataFrame) -> DataFrame:
    """The supplied tables are one file with one row group each, which Spark reads in one task. Here, and nowhere in the
    operators or readers, such a table is dealt out once; a table of as many splits as cores is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return spread(read_table(spark, path, "conversations").select("conv_id", "turn", "role", "text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spread(read_table(spark, path, "documents"))


def usage(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("key_"), F.col("user_id").cast("string")).alias("key_id"),
        F.col("event_type").alias("endpoint"),
        F.col("ts").cast("timestamp").alias("called_at"),
        F.floor("value").cast("int").alias("tokens_saved"),
    )


USAGE_SQL = (
    "SELECT event_id AS id, 'key_' || user_id AS key_id, event_type AS endpoint, ts AS called_at, "
    "CAST(floor(value) AS INTEGER) AS tokens_saved FROM events"
)


def api_keys(spark: SparkSession, path: str) -> DataFrame:
    n = F.col("c_custkey")
    return read_table(spark, path, "customer").select(
        F.concat(F.lit("key_"), n.cast("string")).alias("id"),
        F.sha2(F.concat(F.lit("raw-"), n.cast("string")), 256).alias("key_hash"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("owner_email"),
        F.timestamp_seconds(F.lit(1672531200) + n * 3600).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        (n % 7 != 0).alias("active"),
        F.when(n % 11 == 0, F.lit(0)).otherwise(F.lit(90)).cast("int").alias("quota_limit"),
        F.lit(0).alias("quota_used"),
    )


KEYS_SQL = (
    "SELECT 'key_' || c_custkey AS id, sha256('raw-' || c_custkey) AS key_hash, c_name AS name, "
    "lower(c_mktsegment) || '@example.com' AS owner_email, "
    "TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST(c_custkey AS INTEGER)) AS created_at, c_custkey % 7 <> 0 AS active, "
    "CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 90 END AS INTEGER) AS quota_limit FROM customer"
)


def key_requests(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return read_table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("o_orderpriority").alias("use_case"),
        at.alias("requested_at"),
        F.when(F.col("o_orderstatus") == "F", at).alias("fulfilled_at"),
    )


REQUESTS_SQL = (
    "SELECT o_orderkey AS id, 'c' || o_custkey || '@example.com' AS email, o_orderpriority AS use_case, "
    "o_orderdate AS requested_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS fulfilled_at FROM orders"
)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings as cached queries: the label is the scope, one query per minute."""
    return read_table(spark, path, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("general::"), F.col("label").cast("string")).alias("scope"),
        (F.col("vec_id") * 60000).alias("at"),
        "embedding",
        (F.lit(40) + F.col("vec_id") % 200).cast("long").alias("reply_chars"),
        (F.col("label") != 3).alias("storable"),
    )


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Documents as memory sources: the document's source is the owner."""
    return documents(spark, path).select(
        F.col("source").alias("owner"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.concat(F.lit("note "), (F.col("doc_id") % 50).cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("added_at"),
        F.when(F.col("lang") == "en", F.lit("general")).otherwise(F.concat(F.lit("lang "), "lang")).alias("domain"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("information_seeking")).otherwise(F.lit("task_execution")).alias("intent"),
        F.lit("opening").alias("state"),
    )


SOURCES_SQL = (
    "SELECT source AS owner, doc_id AS seq, 'src-' || doc_id AS source_id, 'note ' || (doc_id % 50) AS title, "
    "text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS added_at, "
    "CASE WHEN lang = 'en' THEN 'general' ELSE 'lang ' || lang END AS domain, "
    "CASE WHEN doc_id % 2 = 0 THEN 'information_seeking' ELSE 'task_execution' END AS intent, "
    "'opening' AS state FROM documents"
)
