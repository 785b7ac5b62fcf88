"""Frames as turns arrive: text features are native, the state per conversation is a few numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.functions.vocab import DEFAULT, Vocabulary
from turnloom.operators.classify import LOOKBACKS, label_frames, lifted_view, plugin_list
from turnloom.operators.signals import LOOKBACK_RISK, Layout
from turnloom.operators.turns import valid_turns


def classify_stream(turns: DataFrame, plugins=None, vocab: Vocabulary = DEFAULT, idle_ms: int = 86_400_000) -> DataFrame:
    """One frame per user turn of a stream whose conversations arrive in turn order.

    The state holds the context bits, the running sums and the look-back bits of the last six turns;
    it is dropped after ``idle_ms`` without a new turn.
    """
    layout = Layout(vocab, plugin_list(plugins))
    rows = layout.features(valid_turns(turns), keep=("conv_id", "turn"))
    ored = [layout.CONTEXT, *range(layout.plugin_slot, layout.score_slot)]
    summed = list(range(layout.score_slot, layout.size))

    # the fold is sent to the workers, so it holds numbers only
    size, context, near_bits = layout.size, layout.CONTEXT, layout.NEAR

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pos, slots, near = state.get if state.exists else (0, [0] * size, [])
        slots, near = list(slots), list(near)
        out = []
        pdf = pd.concat(list(batches)).sort_values("turn")
        for turn, feat in zip(pdf["turn"], pdf["feat"]):
            feat = [int(x) for x in feat]
            history = slots[context]
            for i in ored:
                slots[i] |= feat[i]
            for i in summed:
                slots[i] += feat[i]
            before = []
            for n in LOOKBACKS:
                bits = 0
                for b in near[-n:]:
                    bits |= b
                before.append(bits)
            out.append((key[0], turn, pos, feat, history, list(slots), before))
            near = [*near, feat[near_bits]][-LOOKBACK_RISK:]
            pos += 1
        state.update((pos, slots, near))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "pos", "feat", "hist_bits", "slots", "before"])

    key_type = dict(rows.dtypes)["conv_id"]
    folded = rows.groupBy("conv_id").applyInPandasWithState(
        fold,
        f"conv_id {key_type}, turn long, pos long, feat array<long>, hist_bits long, slots array<long>, before array<long>",
        "pos long, slots array<long>, near array<long>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    lifted = folded.select(
        "conv_id",
        "turn",
        "pos",
        "feat",
        "hist_bits",
        *[F.col("slots")[i].alias(f"slot{i}") for i in ored + summed],
        *[F.col("before")[i].alias(f"before{n}") for i, n in enumerate(LOOKBACKS)],
    )
    users = lifted.filter(lifted_view(layout).cur("is_user"))
    return label_frames(users, layout, ("conv_id", "turn", "pos"))
