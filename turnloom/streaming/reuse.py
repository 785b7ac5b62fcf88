"""The live reply cache on a stream of queries, with a control event that clears a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators.reuse import CAPACITY, MIN_REPLY, REUSE_SCHEMA, THRESHOLD, TTL_MS, ScopeCache, answer_batch


def _load(saved: tuple, cache: ScopeCache) -> ScopeCache:
    meta, vectors = saved
    cache.meta = json.loads(meta)
    if cache.meta:
        cache.vectors = list(np.frombuffer(vectors, dtype=np.float64).reshape(len(cache.meta), -1))
    return cache


def _dump(cache: ScopeCache) -> tuple:
    flat = np.concatenate(cache.vectors).tobytes() if cache.vectors else b""
    return json.dumps(cache.meta, default=int), flat


def reply_reuse_stream(
    queries: DataFrame,
    threshold: float = THRESHOLD,
    ttl_ms: int = TTL_MS,
    capacity: int = CAPACITY,
    min_reply: int = MIN_REPLY,
) -> DataFrame:
    """queries(scope, query_id, at, embedding, reply_chars, storable, clear): ``clear`` empties the scope.

    Same rules as the batch fold; a scope's state is dropped after a silent time-to-live.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cache = ScopeCache(threshold, ttl_ms, capacity, min_reply)
        if state.exists:
            _load(state.get, cache)
        pdf = pd.concat(list(batches)).sort_values(["at", "query_id"])
        for cleared, part in pdf.groupby(pdf["clear"].cumsum(), sort=True):
            if part["clear"].iloc[0]:
                cache.vectors, cache.meta = [], []
                part = part.iloc[1:]
            if len(part):
                yield answer_batch(part, lambda _: cache)
        state.update(_dump(cache))
        state.setTimeoutDuration(ttl_ms)

    return queries.groupBy("scope").applyInPandasWithState(
        run, REUSE_SCHEMA, "meta string, vectors binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
