"""Table schemas shared by the operators, as DDL text."""

from __future__ import annotations

from pyspark.sql import types as T

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, ts TIMESTAMP"

SIGNALS_DDL = "struct<keywords:array<string>,structures:array<string>,urgency:string,affect:string>"
CONFIDENCE_DDL = "struct<intent:double,state:double,domain:double,risk:double>"

API_KEYS = (
    "id STRING, key_hash STRING, name STRING, owner_email STRING, created_at TIMESTAMP, "
    "last_used_at TIMESTAMP, active BOOLEAN, quota_limit INT, quota_used INT"
)
USAGE_LOG = (
    "id BIGINT, key_id STRING, endpoint STRING, called_at TIMESTAMP, tokens_saved INT"
)
KEY_REQUESTS = (
    "id BIGINT, name STRING, email STRING, use_case STRING, requested_at TIMESTAMP, fulfilled_at TIMESTAMP"
)
MEMORY_STORE = (
    "key_id STRING, user_memory STRING, page_memory STRING, updated_at TIMESTAMP"
)

def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


MESSAGE_DDL = "struct<role:string,content:string,timestamp:string>"
EVAL_CASES = (
    "id STRING, message STRING, "
    f"history ARRAY<{MESSAGE_DDL}>, "
    "expectedIntent STRING, expectedDomain STRING, expectedState STRING, expectedRisk ARRAY<STRING>, "
    "expectedType STRING, mustKeep ARRAY<STRING>, shouldDrop ARRAY<STRING>, "
    "expectedMinSavingsPct DOUBLE, notes STRING"
)

PLUGIN_DDL = "struct<id:string,label:string,keywords:array<string>,behavior:string,constraints:string>"
FRAME_DDL = (
    "struct<intent:string,state:string,domain:string,risk:array<string>,"
    f"signals:{SIGNALS_DDL},confidence:{CONFIDENCE_DDL}>"
)
SOURCE_DDL = "struct<title:string,content:string>"

MEMORY_SOURCES = (
    "owner STRING, seq BIGINT, source_id STRING, title STRING, content STRING, added_at TIMESTAMP"
)
USER_MEMORY = (
    "user_id STRING, profile ARRAY<STRING>, patterns ARRAY<STRING>, active_context ARRAY<STRING>, "
    "mistakes ARRAY<STRING>, behavioral_signals ARRAY<STRING>, version INT, last_seq BIGINT"
)
