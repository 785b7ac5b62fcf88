"""Reply reuse by embedding similarity within a scope (domain and session) and a time limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.segments import numbered

THRESHOLD = 0.92
CAPACITY = 500
TTL_MS = 3_600_000
MIN_REPLY = 50


def scope_id(domain: Column, session: Column) -> Column:
    return F.concat(domain, F.lit("::"), session)


BLOCK_ROWS = 1000  # rows of a block of a scope
PACK = "scope string, part long, centre array<double>, radius double, vectors binary, ids binary, at binary, chars binary"
FOUND = "query_id long, sim double, pos long, match_id long, chars long"


def _blocks(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Rows numbered in their scope in order of time and cut into blocks of BLOCK_ROWS rows, however many spans these cover."""
    rows = rows.withColumn("span", F.floor(F.col("at") / ttl_ms).cast("long"))
    placed = numbered(rows, ["scope"], ["at", "query_id"], "span").drop("n_rows")
    return placed.withColumn("part", F.floor(F.col("pos") / BLOCK_ROWS).cast("long"))


def _block_pairs(placed: DataFrame) -> DataFrame:
    """(scope, part, e_part): for each block those, up to itself, with rows in one of its spans of ttl_ms or the span before."""
    spans = placed.select("scope", "part", "span").distinct()
    entries = spans.select("scope", F.col("part").alias("e_part"), F.explode(F.array("span", F.col("span") + 1)).alias("span"))
    return spans.join(entries, ["scope", "span"]).filter(F.col("e_part") <= F.col("part")).select("scope", "part", "e_part").distinct()


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: its vectors, the sphere around them, and what is asked about its rows."""
    pdf = pdf.sort_values("pos")
    matrix = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    centre = matrix.mean(axis=0)
    radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1)).max())
    columns = [np.ascontiguousarray(pdf[c].to_numpy(np.int64)).tobytes() for c in ("query_id", "at", "reply_chars")]
    row = (pdf["scope"].iloc[0], pdf["part"].iloc[0], centre, radius, matrix.tobytes(), *columns)
    return pd.DataFrame([row], columns=["scope", "part", "centre", "radius", "vectors", "ids", "at", "chars"])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _may_reach(threshold: float) -> Column:
    """Whether two spheres may hold vectors with a product of at least threshold."""
    norm_p, norm_e = (F.sqrt(_dot(F.col(c), F.col(c))) for c in ("centre", "e_centre"))
    most = _dot(F.col("centre"), F.col("e_centre")) + norm_p * F.col("e_radius") + norm_e * F.col("radius") + F.col("radius") * F.col("e_radius")
    return most >= threshold - 1e-9


def similar_reply(queries: DataFrame, threshold: float = THRESHOLD, ttl_ms: int = TTL_MS) -> DataFrame:
    """Best earlier entry of the same scope for every query(query_id, scope, at, embedding, reply_chars).

    ``at`` is a time in milliseconds. Every earlier entry at most ``ttl_ms`` old is compared, the earliest of the best wins.
    Rows are packed into blocks of one scope in order of time; a block meets the blocks that may hold entries young enough,
    unless the spheres around their vectors show that no product can reach the threshold, and each pair that is left is one
    bounded matrix product. No hits feed back here; see reply_reuse for the live cache.
    """
    placed = _blocks(queries.select("query_id", "scope", "at", "embedding", "reply_chars"), ttl_ms)
    packs = placed.groupBy("scope", "part").applyInPandas(_pack, PACK)
    held = packs.select(*(F.col(c).alias(c if c == "scope" else f"e_{c}") for c in packs.columns))
    both = _block_pairs(placed).join(packs, ["scope", "part"]).join(held, ["scope", "e_part"]).filter(_may_reach(threshold))
    wanted = ["part", "e_part", "vectors", "ids", "at", "e_vectors", "e_ids", "e_at", "e_chars"]

    def best_of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, at, e_ids, e_at, e_chars = (np.frombuffer(x, np.int64) for x in (r.ids, r.at, r.e_ids, r.e_at, r.e_chars))
                entries = np.frombuffer(r.e_vectors).reshape(len(e_ids), -1)
                sims = np.round(np.frombuffer(r.vectors).reshape(len(ids), -1) @ entries.T, 12)
                pos, e_pos = r.part * BLOCK_ROWS + np.arange(len(ids)), r.e_part * BLOCK_ROWS + np.arange(len(e_ids))
                sims[(pos[:, None] <= e_pos) | (at[:, None] - e_at > ttl_ms)] = -np.inf
                best = sims.argmax(axis=1)  # the earliest of equals
                top = sims[np.arange(len(ids)), best]
                hits = np.flatnonzero(top >= threshold)
                found = best[hits]
                yield pd.DataFrame({"query_id": ids[hits], "sim": top[hits], "pos": e_pos[found], "match_id": e_ids[found], "chars": e_chars[found]})

    best = F.max(F.struct("sim", (-F.col("pos")).alias("back"), "match_id", "chars")).alias("b")
    hits = both.select(*wanted).mapInPandas(best_of_pairs, FOUND).groupBy("query_id").agg(best)
    return queries.select("query_id").join(hits, "query_id", "left").select(
        "query_id",
        F.col("b").isNotNull().alias("hit"),
        F.col("b.match_id").alias("match_id"),
        (F.floor(F.col("b.sim") * 1000 + 0.5) / 1000).alias("similarity"),
        F.floor(F.col("b.chars") / 4 + 0.5).cast("long").alias("saved_tokens"),
    )


def cache_stats(results: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Hits, misses, hit rate and tokens saved over lookup results; with ``live`` entries (see lru_keep) their number too."""
    hits = F.count_if("hit")
    if live is not None:
        results = results.select("hit", "saved_tokens", F.lit(0).alias("entry"))
        live = live.select(F.lit(None).cast("boolean").alias("hit"), F.lit(None).cast("long").alias("saved_tokens"), F.lit(1).alias("entry"))
        both = results.unionByName(live).agg(F.sum("entry").alias("total_entries"), *_stats(hits, F.count("hit")))
        return both.withColumn("total_entries", F.coalesce("total_entries", F.lit(0)))
    return results.agg(*_stats(hits, F.count("hit")))


def _stats(hits: Column, lookups: Column) -> list[Column]:
    return [
        hits.alias("total_hits"),
        F.count_if(~F.col("hit")).alias("total_misses"),
        F.when(lookups > 0, hits / lookups).otherwise(F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("tokens_saved"),
    ]


def lru_keep(entries: DataFrame, now_ms: Column, ttl_ms: int = TTL_MS, capacity: int | None = CAPACITY, per_scope: bool = True) -> DataFrame:
    """Drop expired entries, keep the most recently hit (all without a capacity); the limit is applied per task first."""
    live = entries.filter(now_ms - F.col("last_hit") <= ttl_ms)
    order = [F.col("last_hit").desc(), F.col("entry_id")]
    if capacity is None:
        return live
    if not per_scope:
        return live.orderBy(*order).limit(capacity)
    w = Window.partitionBy("scope").orderBy(*order)
    return live.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= capacity).drop("_rn")


def clear_session(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Remove all entries of the given sessions."""
    return entries.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


class ScopeCache:
    """Live entries of one scope: lookup, hit extends life, miss inserts, at most ``capacity`` entries."""

    def __init__(self, threshold: float, ttl_ms: int, capacity: int, min_reply: int):
        self.threshold, self.ttl_ms, self.capacity, self.min_reply = threshold, ttl_ms, capacity, min_reply
        self.vectors: list[np.ndarray] = []
        self.meta: list[list] = []  # [query_id, reply_chars, last_hit]

    def ask(self, query_id, at, embedding, reply_chars, storable) -> tuple:
        live = [i for i, m in enumerate(self.meta) if at - m[2] <= self.ttl_ms]
        if len(live) < len(self.meta):
            self.vectors, self.meta = [self.vectors[i] for i in live], [self.meta[i] for i in live]
        vector = np.asarray(embedding, dtype=np.float64)
        if self.vectors:
            sims = np.stack(self.vectors) @ vector
            best = int(sims.argmax())
            if sims[best] >= self.threshold:
                match = self.meta[best]
                match[2] = at
                return (True, match[0], float(np.floor(sims[best] * 1000 + 0.5) / 1000), int(np.floor(match[1] / 4 + 0.5)))
        if storable and reply_chars >= self.min_reply:
            self.vectors.append(vector)
            self.meta.append([query_id, reply_chars, at])
            if len(self.meta) > self.capacity:
                oldest = min(range(len(self.meta)), key=lambda i: self.meta[i][2])
                del self.vectors[oldest], self.meta[oldest]
        return (False, None, None, None)


REUSE_SCHEMA = "scope string, query_id long, hit boolean, match_id long, similarity double, saved_tokens long"


def answer_batch(pdf: pd.DataFrame, cache_of) -> pd.DataFrame:
    """Run ordered queries through their caches."""
    out = []
    for r in pdf.itertuples(index=False):
        answer = cache_of(r).ask(r.query_id, r.at, r.embedding, r.reply_chars, r.storable)
        out.append((r.scope, r.query_id, *answer))
    frame = pd.DataFrame(out, columns=["scope", "query_id", "hit", "match_id", "similarity", "saved_tokens"])
    return frame.astype({"match_id": "Int64", "saved_tokens": "Int64", "similarity": "float64"})


def _islands(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Split a scope where it was silent for a whole time-to-live: every entry has expired there."""
    ticked = rows.withColumn("tick", F.floor(F.col("at") / (ttl_ms + 1)).cast("long"))
    ticks = ticked.select("scope", "tick").distinct()
    w = Window.partitionBy("scope").orderBy("tick")
    gap = F.coalesce(F.col("tick") - F.lag("tick").over(w) > 1, F.lit(False)).cast("long")
    numbered_ticks = ticks.withColumn("gap", gap).select("scope", "tick", F.sum("gap").over(w).alias("island"))
    return ticked.join(numbered_ticks, ["scope", "tick"]).drop("tick")


def reply_reuse(
    queries: DataFrame,
    threshold: float = THRESHOLD,
    ttl_ms: int = TTL_MS,
    capacity: int = CAPACITY,
    min_reply: int = MIN_REPLY,
) -> DataFrame:
    """The live cache over queries(query_id, scope, at, embedding, reply_chars, storable), in time order per scope.

    A hit prolongs an entry and suppresses an insert, so each scope is a sequential fold. It runs over
    sorted partitions in Arrow batches with a state of at most ``capacity`` entries, and a scope is
    split wherever it was silent long enough for everything to expire.
    """
    columns = ["scope", "island", "at", "query_id", "embedding", "reply_chars", "storable"]
    rows = _islands(queries, ttl_ms).select(*columns)
    ordered = rows.repartition("scope", "island").sortWithinPartitions("scope", "island", "at", "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, None

        def cache_of(r):
            nonlocal current, cache
            if (r.scope, r.island) != current:
                current, cache = (r.scope, r.island), ScopeCache(threshold, ttl_ms, capacity, min_reply)
            return cache

        for pdf in batches:
            if len(pdf):
                yield answer_batch(pdf, cache_of)

    return ordered.mapInPandas(run, REUSE_SCHEMA)
