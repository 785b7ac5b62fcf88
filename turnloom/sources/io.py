"""Readers and writers: turns, evaluation cases, usage tables, request payloads, memory upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators.turns import valid_turns


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_turns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Turns with a fixed schema; rows that are no user or assistant turn are dropped at the scan."""
    return valid_turns(spark.read.schema(schemas.TURNS).format(fmt).load(path))


def read_eval_cases(spark: SparkSession, path: str, ddl: str = schemas.EVAL_CASES) -> DataFrame:
    """A JSON array or JSON lines; an empty or missing history becomes an empty list."""
    schema = schemas.struct(ddl)
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    is_array = head[0]["value"].lstrip().startswith("[")
    rows = spark.read.schema(schema).json(path, multiLine=is_array)
    if "history" in rows.columns:
        rows = rows.withColumn("history", F.coalesce("history", F.array().cast(schema["history"].dataType)))
    return rows


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    write_jsonl(summary, f"{path}/summary")
    write_jsonl(rows, f"{path}/results")


def append_usage(usage: DataFrame, path: str) -> None:
    """Append usage facts, one folder per day. The used counter is derived from the facts, not stored."""
    usage.withColumn("call_date", F.to_date("called_at")).write.mode("append").partitionBy("call_date").parquet(path)


def read_saas_tables(spark: SparkSession, path: str, fmt: str = "parquet", jdbc: dict | None = None) -> dict[str, DataFrame]:
    """api_keys, usage_log and key_requests from files, or from a database when JDBC options are given."""
    tables = {"api_keys": schemas.API_KEYS, "usage_log": schemas.USAGE_LOG, "key_requests": schemas.KEY_REQUESTS}
    out = {}
    for name, schema in tables.items():
        if jdbc:
            raw = spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
        else:
            raw = spark.read.schema(schema).format(fmt).load(f"{path}/{name}")
        out[name] = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.struct(schema)])
    return out


def upserted(current: DataFrame, updates: DataFrame, keys: list[str], deletes: DataFrame | None = None) -> DataFrame:
    """Current rows with updates inserted or replaced by key, and deleted keys removed."""
    kept = current.join(updates.select(*keys).distinct(), keys, "left_anti")
    merged = kept.unionByName(updates, allowMissingColumns=True)
    return merged if deletes is None else merged.join(deletes.select(*keys).distinct(), keys, "left_anti")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], deletes: DataFrame | None = None) -> str:
    """Write the next version of a keyed table next to the current one and return its path.

    The old version is never overwritten while it is read, so a lost executor or a failed write leaves
    the table intact; the newest version with a success marker is the current one.
    """
    versions = table_versions(spark, path)
    if versions:
        merged = upserted(spark.read.parquet(f"{path}/v={versions[-1]}"), updates, keys, deletes)
    else:
        merged = updates if deletes is None else updates.join(deletes.select(*keys).distinct(), keys, "left_anti")
    target = f"{path}/v={(versions[-1] if versions else 0) + 1}"
    merged.write.mode("overwrite").parquet(target)
    return target


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a keyed table, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    versions = table_versions(spark, path)
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def parse_plugins(payload: Column) -> Column:
    """Plugins from a JSON array; items with a missing field are dropped."""
    parsed = F.from_json(payload, f"array<{schemas.PLUGIN_DDL}>")
    complete = F.filter(
        parsed,
        lambda p: p["id"].isNotNull()
        & p["label"].isNotNull()
        & p["keywords"].isNotNull()
        & p["behavior"].isNotNull()
        & p["constraints"].isNotNull(),
    )
    return F.coalesce(complete, F.array().cast(f"array<{schemas.PLUGIN_DDL}>"))


def default_frame() -> Column:
    """The frame of an empty message without history."""
    return F.from_json(
        F.lit(
            '{"intent":"task_execution","state":"opening","domain":"general","risk":[],'
            '"signals":{"keywords":[],"structures":[],"urgency":"low","affect":"neutral"},'
            '"confidence":{"intent":0.68,"state":0.9,"domain":0.62,"risk":1.0}}'
        ),
        schemas.FRAME_DDL,
    )


def parse_frame(payload: Column) -> Column:
    """A frame from JSON; an incomplete one becomes the default frame."""
    f = F.from_json(payload, schemas.FRAME_DDL)

    def present(name: str) -> Column:
        return F.coalesce(f[name], F.lit("")) != ""

    ok = present("intent") & present("state") & present("domain") & f["signals"].isNotNull() & f["confidence"].isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), f).otherwise(default_frame())


def parse_source(payload: Column) -> Column:
    """A source from JSON; missing fields become empty strings."""
    s = F.from_json(payload, schemas.SOURCE_DDL)
    return F.struct(
        F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["content"], F.lit("")).alias("content")
    )


def parse_messages(payload: Column) -> Column:
    """Messages from a JSON array; items without a known role or a text are dropped."""
    parsed = F.from_json(payload, f"array<{schemas.MESSAGE_DDL}>")
    valid = F.filter(parsed, lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())
    return F.coalesce(valid, F.array().cast(f"array<{schemas.MESSAGE_DDL}>"))


def parse_memory_store(store: DataFrame) -> DataFrame:
    """The per-key JSON documents as typed columns, parsed once."""
    user = "struct<profile:array<string>,patterns:array<string>,activeContext:array<string>,mistakes:array<string>," \
           "behavioralSignals:array<string>,version:int,lastUpdated:string>"
    pages = "struct<sources:array<struct<id:string,title:string,content:string,addedAt:string>>," \
            "pages:array<struct<path:string,title:string,markdown:string,updatedAt:string,sourceIds:array<string>," \
            "tags:array<string>>>,version:int,lastUpdated:string>"
    return store.select(
        "key_id",
        F.from_json("user_memory", user).alias("user_memory"),
        F.from_json("page_memory", pages).alias("page_memory"),
        "updated_at",
    )
