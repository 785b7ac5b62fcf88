"""Turn tables: valid turns, request split, forwarding order, uniqueness, latest user text, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.segments import SEGMENT, numbered, segment_of

CHAT_ROLES = ("user", "assistant")


def valid_turns(turns: DataFrame) -> DataFrame:
    """Keep rows whose role is user or assistant and whose text is present."""
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return turns.filter(F.col("role").isin(*CHAT_ROLES) & F.col("text").isNotNull() & keyed)


def split_request(turns: DataFrame) -> DataFrame:
    """Per conversation: first system text, last user turn as the current one, number of turns before it.

    One aggregation with map-side combine; no turn text but the two kept ones reaches the reducers.
    """
    chat = F.col("role").isin(*CHAT_ROLES)
    user = F.col("role") == "user"
    heads = turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias(
            "system_text"
        ),
        F.max(F.when(user, F.col("turn"))).alias("current_turn"),
        F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("current_text"),
        F.count_if(chat).alias("n_chat"),
        F.count_if(chat & user).alias("n_user"),
    )
    return heads


def request_rows(turns: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The turns a request works on: valid turns up to and including the last user turn."""
    valid = valid_turns(turns)
    if heads is None:
        heads = valid.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("current_turn"))
    return valid.join(heads.select("conv_id", "current_turn"), "conv_id").filter(F.col("turn") <= F.col("current_turn"))


def history_sizes(turns: DataFrame) -> DataFrame:
    """split_request plus the length of the history (valid turns before the current one)."""
    heads = split_request(turns).filter(F.col("current_turn").isNotNull())
    sizes = request_rows(turns, heads).groupBy("conv_id").agg((F.count(F.lit(1)) - 1).alias("n_history"))
    return heads.select("conv_id", "system_text", "current_turn", "current_text").join(sizes, "conv_id")


def forward_messages(system: Column, compressed: Column, current: Column) -> Column:
    """Message array to send on: system text, compressed turns, then the current text unless already there."""
    message = "struct<role:string,text:string>"
    lead = F.when(system.isNotNull(), F.array(F.struct(F.lit("system").alias("role"), system.alias("text")))).otherwise(
        F.array().cast(f"array<{message}>")
    )
    kept = F.transform(compressed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    present = F.exists(compressed, lambda m: (m["role"] == "user") & (m["text"] == current))
    tail = F.when(
        ~present & (F.coalesce(current, F.lit("")) != ""),
        F.array(F.struct(F.lit("user").alias("role"), current.alias("text"))),
    ).otherwise(F.array().cast(f"array<{message}>"))
    return F.concat(lead, kept, tail)


def unique_turns(turns: DataFrame) -> DataFrame:
    """Keep the first turn of each (conversation, role, text).

    The shuffle key contains a hash of the text, so a conversation spreads over many tasks, and
    repeated texts are combined before the shuffle.
    """
    first = turns.groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn"))
    return first.select("conv_id", "turn", "role", "text")


def unique_messages(messages: str) -> str:
    """The same for a bounded message array, as SQL text: first of each (role, text) stays."""
    earlier = "exists(slice(a, 1, i), o -> o.role = m.role AND o.text = m.text)"
    return f"transform(array({messages}), a -> filter(a, (m, i) -> NOT {earlier}))[0]"


def latest_user_text(turns: DataFrame) -> DataFrame:
    """Last user text per conversation, else the last text."""
    user = F.col("role") == "user"
    return valid_turns(turns).groupBy("conv_id").agg(
        F.coalesce(
            F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))),
            F.max_by("text", "turn"),
        ).alias("latest_text")
    )


def recency_weight(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Position over group size, 0-based, for every valid turn."""
    rows = valid_turns(turns).select("conv_id", "turn", "role").withColumn("seg", segment_of(F.col("turn"), size))
    placed = numbered(rows, ["conv_id"], ["turn"], "seg")
    return placed.select(
        "conv_id", "turn", "role", "pos", (F.col("pos") / F.greatest(F.lit(1), F.col("n_rows"))).alias("recency")
    )


def keep_last(rows: DataFrame, keys: list[str], order: str, n: int, tie: str) -> DataFrame:
    """The n latest rows per key, of equal times those with the larger ``tie``; the limit is applied per task first."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
