"""A request from end to end: classify the conversation, compress its history, look up the prompt policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from turnloom.functions.vocab import DEFAULT, LABEL, Vocabulary
from turnloom.operators.classify import classify, last_frames
from turnloom.operators.compress import Compression, compress
from turnloom.operators.route import route_policy


def handle(
    turns: DataFrame, plugins=None, vocab: Vocabulary = DEFAULT, protect: bool = True, memory: Column | None = None, label: str = LABEL
) -> tuple[DataFrame, Compression]:
    """(routed, compression): a row per conversation with its frame, behaviour, constraints, system_prompt and the measures
    of its compression; and the compression itself, whose turns go to the model after the prompt."""
    frames = last_frames(classify(turns, plugins, vocab))
    done = compress(turns, frames, protect, vocab, plugins, label)
    routed = route_policy(frames, plugins, memory, label)
    measures = done.summary.select("conv_id", "protected", "kept_reasons", "dropped_count", "original_tokens", "compressed_tokens", "tokens_saved", "n_compressed")
    return routed.join(measures, "conv_id"), done
