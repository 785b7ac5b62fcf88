"""Cross-session memory: the memory frame of one session becomes a source whose pages the next session recalls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.vocab import DEFAULT, Vocabulary
from turnloom.operators.compress import memory_frames
from turnloom.operators.memory import page_heads, page_sections, source_id
from turnloom.operators.profiles import frame_to_source
from turnloom.operators.recall import context_block, rank_pages, write_index
from turnloom.session import durable


def frame_sources(memory: DataFrame, owner: str = "conv_id", seq=None, added_at=None) -> DataFrame:
    """Memory frames as sources: owner, seq, source_id, title, content, added_at and the routing labels."""
    rows = memory.withColumns(
        {
            "owner": F.col(owner).cast("string"),
            "seq": seq if seq is not None else F.lit(1).cast("long"),
            "added_at": added_at if added_at is not None else F.lit(None).cast("timestamp"),
            "s": frame_to_source(F.floor((F.col("n") - 1) / 2)),
        }
    )
    return rows.select(
        "owner",
        "seq",
        source_id(F.col("owner"), F.col("seq"), F.col("s.title")).alias("source_id"),
        F.col("s.title").alias("title"),
        F.col("s.content").alias("content"),
        "added_at",
        "domain",
        "intent",
        "state",
    )


def carry_over(first: DataFrame, second: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(query_id, context): what second(query_id, owner, text) recalls from the sessions in ``first``.

    The sources are written first, as each is read several times and is a long expression, and their pages as an index, which
    is all that the second sessions read.
    """
    index = write_index(page_sections(durable(frame_sources(memory_frames(first, vocab=vocab)))))
    return context_block(rank_pages(second, index), page_heads(index.sections), second, "LLM Wiki context:", "", with_owner=False)


def memory_trigger(frames: DataFrame, min_history: int = 4, any_state: bool = False) -> DataFrame:
    """Frames whose turn closes or resolves a conversation with enough history; every such turn with ``any_state``."""
    long_enough = F.col("pos") >= min_history
    return frames.filter(long_enough if any_state else long_enough & F.col("state").isin("closing", "resolving"))
