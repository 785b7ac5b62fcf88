"""API usage: dashboards, quotas, waitlist, key lookup, recent calls, rolling counts, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import key_hash
from turnloom.operators.turns import keep_last

RATE_LIMIT = 60
ADDRESS_LIMIT = 20
WINDOW_MS = 60_000


def _measures(cutoff: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_calls"),
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("long").alias("total_tokens_saved"),
        F.count_if(F.col("called_at") >= cutoff).alias("last24h_calls"),
    ]


def day_before(now: Column) -> Column:
    return now - F.expr("INTERVAL 24 HOURS")


def usage_by_key(usage: DataFrame, now: Column) -> DataFrame:
    """Calls, tokens saved and calls of the last 24 hours for all keys at once."""
    return usage.groupBy("key_id").agg(*_measures(day_before(now)))


def own_usage(usage: DataFrame, key_id: str, now: Column) -> DataFrame:
    """The same measures for one key; zeros for an unknown key."""
    return usage.filter(F.col("key_id") == key_id).agg(*_measures(day_before(now)))


def key_dashboard(keys: DataFrame, usage: DataFrame, now: Column, derive_quota: bool = False) -> DataFrame:
    """Every key with its measures. The log is aggregated before the join, so it never meets the keys row by row.

    With ``derive_quota`` the used counter is the number of calls in the log, from the same aggregation.
    """
    joined = keys.drop("key_hash").join(
        usage_by_key(usage, now), keys["id"] == F.col("key_id"), "left"
    ).drop("key_id")
    joined = joined.fillna(0, ["total_calls", "total_tokens_saved", "last24h_calls"])
    return joined.withColumn("quota_used", F.col("total_calls").cast("int")) if derive_quota else joined


def newest_first(rows: DataFrame, at: str, tie: str) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), F.col(tie))


def dashboard_kpis(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if("active").alias("active_keys"),
        F.coalesce(F.sum("last24h_calls"), F.lit(0)).alias("calls_24h"),
        F.coalesce(F.sum("total_tokens_saved"), F.lit(0)).alias("tokens_saved"),
    )


def quota_utilisation(dashboard: DataFrame) -> DataFrame:
    """Used share of the quota in percent, capped at 100, with the warning level."""
    share = F.round(F.col("quota_used") / F.col("quota_limit") * 100).cast("long")
    pct = F.when(F.col("quota_limit") > 0, F.least(F.lit(100), share)).otherwise(F.lit(0)).cast("long")
    level = F.when(F.col("quota_pct") >= 90, F.lit("full")).when(F.col("quota_pct") >= 70, F.lit("warn")).otherwise(F.lit(""))
    return dashboard.withColumn("quota_pct", pct).withColumn("quota_level", level)


def derived_quota(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """The used counter derived from the log instead of being bumped per call."""
    used = usage.groupBy("key_id").agg(F.count(F.lit(1)).cast("int").alias("_used"))
    joined = keys.join(used, keys["id"] == used["key_id"], "left").drop("key_id")
    return joined.withColumn("quota_used", F.coalesce("_used", F.lit(0))).drop("_used")


def waitlist_count(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("fulfilled_at").isNull()).agg(F.count(F.lit(1)).alias("waiting"))


def waitlist_position(requests: DataFrame) -> DataFrame:
    """For every e-mail: open requests of other e-mails plus one. The total is one row."""
    open_flag = F.col("fulfilled_at").isNull()
    own = requests.groupBy("email").agg(F.count_if(open_flag).alias("own"))
    total = own.agg(F.sum("own").alias("total"))
    # one row by construction
    return own.join(F.broadcast(total)).select("email", (F.col("total") - F.col("own") + 1).alias("position"))


def newest_requests(requests: DataFrame) -> DataFrame:
    return newest_first(requests, "requested_at", "id")


def recent_usage(usage: DataFrame, n: int = 100) -> DataFrame:
    """The n latest calls of every key, of equal times those with the larger id."""
    return keep_last(usage, ["key_id"], "called_at", n, "id")


def resolve_key(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Active key per call, by the hash of the raw key; the key's last use is its latest call."""
    hashed = calls.withColumn("key_hash", key_hash(F.col("raw_key")))
    active = keys.filter("active").drop("last_used_at")
    return hashed.drop("raw_key").join(active, "key_hash").drop("key_hash")


def last_used(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Latest call of every active key; the calls are brought down to one row per raw key before they meet the keys."""
    latest = calls.groupBy("raw_key").agg(F.max("called_at").alias("called_at"))
    return resolve_key(latest, keys).groupBy("id").agg(F.max("called_at").alias("last_used_at"))


def usage_rollup(usage: DataFrame, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Calls and tokens saved per key over sliding event-time windows; the same form works on a stream.

    Rows are first summed per slide step, so each row is not copied into every window it belongs to.
    """
    steps = usage.groupBy("key_id", F.window("called_at", slide).alias("w")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("tokens_saved").alias("s")
    )
    rolled = steps.select("key_id", F.col("w.start").alias("at"), "c", "s").groupBy(
        "key_id", F.window("at", size, slide).alias("w")
    )
    return rolled.agg(F.sum("c").alias("calls"), F.sum("s").alias("tokens_saved")).select(
        "key_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "tokens_saved"
    )


# --- rate limit ------------------------------------------------------------------------------------
#
# A window opens at the first call and stays open while now - start <= length. With buckets of
# length + 1 milliseconds at most one window opens per bucket: at the first call whose offset in the
# bucket is not below the offset of the window opened in the bucket before (or at the first call when
# none was). So a key's timeline is a chain of small functions "offset in, offset out". Spans of buckets
# are evaluated independently, for every offset they could be entered with; their functions are composed
# in a tree over ranges of spans, and the entries come back down the same tree. The largest group
# is a span's calls, FAN functions of a level, or a key's functions of FAN ** LEVELS spans each (half a year).

BUCKETS_PER_SPAN = 64
FAN = 64
LEVELS = 2
NONE = -1
_ANY = np.iinfo(np.int64).max
_FUNCTION = "key_id string, id long, block long, first long, last long, uppers array<long>, exits array<long>"


def _whole_groups(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows ordered by (key_id, number) as tables of whole groups, with the bounds of the groups in each."""
    held, name = [], None

    def given():
        table = pa.Table.from_batches(held)
        return table, np.append(np.flatnonzero(changes(table)), table.num_rows)

    def changes(rows):
        keys, numbers = rows.column("key_id"), rows.column(number)
        beside = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(numbers[1:], numbers[:-1]))
        return np.append(True, beside.to_numpy(zero_copy_only=False))

    for batch in batches:
        if not batch.num_rows:
            continue
        tail = int(np.flatnonzero(changes(batch))[-1])
        if held and name != (batch.column("key_id")[0], batch.column(number)[0]):
            yield given()
            held = []
        if tail:
            held.append(batch.slice(0, tail))
            yield given()
            held = []
        held.append(batch.slice(tail))
        name = (batch.column("key_id")[-1], batch.column(number)[-1])
    if held:
        yield given()


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    flat, cuts = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(flat, cuts[:-1])


def _bucket_lists(buckets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
    return buckets[np.append(0, cuts)], np.split(offsets, cuts)


def _step(state: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offset of the window opened in a bucket for each entry state (NONE: no window open)."""
    at = np.searchsorted(offsets, state, side="left")
    return np.where(at < len(offsets), offsets[np.minimum(at, len(offsets) - 1)], NONE)


def _span_function(buckets: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exit state of a span for every way it can be entered, as steps (upper bound of entry, exit)."""
    if buckets[0] % BUCKETS_PER_SPAN == 0:
        uppers, state = np.append(lists[0], _ANY), np.append(lists[0], NONE)
    else:  # entering matters only when the span's first bucket has calls
        uppers, state = np.array([_ANY]), lists[0][:1]
    for i in range(1, len(buckets)):
        if buckets[i] != buckets[i - 1] + 1:
            state = np.full_like(state, NONE)
        state = _step(state, lists[i])
    if buckets[-1] % BUCKETS_PER_SPAN != BUCKETS_PER_SPAN - 1:
        state = np.full_like(state, NONE)
    return _fewest(uppers, state)


def _fewest(uppers: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(exits[1:] != exits[:-1], True)
    return uppers[keep], exits[keep]


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    kinds = {"key_id": pa.string(), "uppers": pa.list_(pa.int64()), "exits": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names=names)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each span from its instants in order."""
    for table, bounds in _whole_groups(batches, "span"):
        buckets, offsets = _longs(table, "bucket"), _longs(table, "off")
        # a span without calls in its last bucket is left without a window, however it is entered
        open_end = (buckets[bounds[1:] - 1] % BUCKETS_PER_SPAN == BUCKETS_PER_SPAN - 1).tolist()
        closed = np.array([_ANY]), np.array([NONE])
        found = [
            _span_function(*_bucket_lists(buckets[a:b], offsets[a:b])) if is_open else closed
            for a, b, is_open in zip(bounds[:-1].tolist(), bounds[1:].tolist(), open_end)
        ]
        spans = _longs(table, "span")[bounds[:-1]]
        keys = table.column("key_id").take(pa.array(bounds[:-1])).to_pylist()
        yield _batch(
            ["key_id", "id", "block", "first", "last", "uppers", "exits"],
            [keys, spans, spans // FAN, spans, spans, [f[0] for f in found], [f[1] for f in found]],
        )


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One function for the functions of each block, in order; where spans are missing between two, no window is open."""
    for table, bounds in _whole_groups(batches, "block"):
        first, last = _longs(table, "first"), _longs(table, "last")
        uppers, exits = _lists(table, "uppers"), _lists(table, "exits")
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            state = exits[a]
            for i in range(a + 1, b):
                if first[i] != last[i - 1] + 1:
                    state = np.full_like(state, NONE)
                state = exits[i][np.searchsorted(uppers[i], state, side="left")]
            found.append(_fewest(uppers[a], state))
        blocks = _longs(table, "block")[bounds[:-1]]
        keys = table.column("key_id").take(pa.array(bounds[:-1])).to_pylist()
        yield _batch(
            ["key_id", "id", "block", "first", "last", "uppers", "exits"],
            [keys, blocks, blocks // FAN, first[bounds[:-1]], last[bounds[1:] - 1], [f[0] for f in found], [f[1] for f in found]],
        )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each function of a block is entered with, from the state that the block is entered with."""
    for table, bounds in _whole_groups(batches, "block"):
        first, last, entry = _longs(table, "first"), _longs(table, "last"), _longs(table, "entry")
        uppers, exits = _lists(table, "uppers"), _lists(table, "exits")
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            state = entry[a]
            for i in range(a, b):
                if i > a and first[i] != last[i - 1] + 1:
                    state = NONE
                out.append(state)
                state = exits[i][np.searchsorted(uppers[i], state, side="left")]
        yield _batch(["key_id", "id", "entry"], [table.column("key_id").to_pylist(), _longs(table, "id"), out])


def _starts(spans: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, entries: np.ndarray, period: int) -> np.ndarray:
    """The start of the window of each instant; the instants are in order, spans numbers the spans from 0 on. Of all runs of
    adjacent buckets in a span the first buckets are worked on at once, then the second ones, and so on."""
    new = np.append(True, (spans[1:] != spans[:-1]) | (buckets[1:] != buckets[:-1]))
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    end, bucket, span = np.append(first[1:], len(of)), buckets[first], spans[first]
    enters = np.append(True, span[1:] != span[:-1])
    alone = enters | np.append(True, bucket[1:] != bucket[:-1] + 1)
    place = np.arange(len(first)) - np.maximum.accumulate(np.where(alone, np.arange(len(first)), 0))
    state = np.where(enters & (bucket % BUCKETS_PER_SPAN == 0), entries[first], NONE)
    opened = np.full(len(first), NONE, np.int64)
    keys = of * period + offsets  # ascending
    order = np.argsort(place, kind="stable")
    for now in np.split(order, np.cumsum(np.bincount(place))[:-1]):
        later = now[place[now] > 0]
        state[later] = opened[later - 1]
        at = np.searchsorted(keys, now * period + np.maximum(state[now], 0), side="left")
        opened[now] = np.where(at < end[now], offsets[np.minimum(at, len(offsets) - 1)], NONE)
    base, own = buckets * period, opened[of]
    return np.where((own != NONE) & (offsets >= own), base + own, base - period + state[of])


def _window_starts(period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, "span"):
            buckets, offsets = _longs(table, "bucket"), _longs(table, "off")
            starts = _starts(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), buckets, offsets, _longs(table, "entry"), period)
            columns = [table.column("key_id").to_pylist(), buckets * period + offsets, _longs(table, "n"), starts]
            yield _batch(["key_id", "ms", "n", "window_start"], columns)

    return run


def _together(rows: DataFrame, number: str) -> DataFrame:
    """All rows of a (key_id, number) in one task. The hash is a column of its own, so that no join's partitioning stands in
    for this one: Spark may split that where a key is hot."""
    return rows.repartition(F.xxhash64("key_id", number))


def _span_entries(functions: DataFrame) -> DataFrame:
    """(key_id, span, entry): the state every span is entered with, from the functions of the spans."""
    levels = []
    for _ in range(LEVELS):
        levels.append(_together(functions.filter("key_id IS NOT NULL AND block IS NOT NULL"), "block"))
        functions = levels[-1].sortWithinPartitions("key_id", "block", "first").mapInArrow(_composed, _FUNCTION)
    whole = functions.withColumns({"block": F.lit(0).cast("long"), "entry": F.lit(NONE).cast("long")})
    for level in [None, *reversed(levels)]:
        rows = whole if level is None else level.join(entries.withColumnRenamed("id", "block"), ["key_id", "block"])
        entries = _together(rows, "block").sortWithinPartitions("key_id", "block", "first").mapInArrow(
            _entered, "key_id string, id long, entry long"
        )
    return entries.withColumnRenamed("id", "span")


def rate_limit(calls: DataFrame, limit: int = RATE_LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add the window each call falls into and whether it is allowed.

    calls(key_id STRING, call_id, called_at). Denied calls do not extend or reopen a window. Calls without a key or a time are
    left out.
    """
    period = window_ms + 1
    calls = calls.withColumn("ms", F.expr("floor(unix_micros(CAST(called_at AS TIMESTAMP)) / 1000)").cast("long"))
    calls = calls.filter("key_id IS NOT NULL AND ms IS NOT NULL")
    instants = calls.groupBy("key_id", "ms").agg(F.count(F.lit(1)).alias("n"))
    placed = instants.select(
        "key_id",
        "n",
        F.floor(F.col("ms") / period).cast("long").alias("bucket"),
        F.pmod("ms", F.lit(period)).cast("long").alias("off"),
    ).withColumn("span", F.floor(F.col("bucket") / BUCKETS_PER_SPAN).cast("long"))
    order = ["key_id", "span", "bucket", "off"]
    functions = _together(placed, "span").sortWithinPartitions(*order).mapInArrow(_functions, _FUNCTION)
    entered = _together(placed.join(_span_entries(functions), ["key_id", "span"]), "span")
    counted = entered.sortWithinPartitions(*order).mapInArrow(
        _window_starts(period), "key_id string, ms long, n long, window_start long"
    )
    # calls before an instant inside its window; a window has at most window_ms + 1 instants
    w = Window.partitionBy("key_id", "window_start").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    within = Window.partitionBy("key_id", "ms").orderBy("call_id")
    return (
        calls.join(counted.select("key_id", "ms", "window_start", "before"), ["key_id", "ms"])
        .withColumn("allowed", F.col("before") + F.row_number().over(within) <= limit)
        .select("key_id", "call_id", "called_at", F.timestamp_millis("window_start").alias("window_start"), "allowed")
    )


def usage_report(keys: DataFrame, usage: DataFrame, requests: DataFrame, now: Column, recent: int = 100) -> dict:
    """All reporting tables of the admin view."""
    dashboard = key_dashboard(keys, usage, now, derive_quota=True)
    return {
        "dashboard": quota_utilisation(dashboard),
        "kpis": dashboard_kpis(dashboard),
        "recent": recent_usage(usage, recent),
        "waitlist": waitlist_count(requests),
        "positions": waitlist_position(requests),
        "requests": newest_requests(requests),
    }
