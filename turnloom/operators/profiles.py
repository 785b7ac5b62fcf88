"""Per-user memory: items found in sessions, folded in order into five short lists; session-to-source conversion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from turnloom import schemas
from turnloom.functions.regex import java
from turnloom.functions.text import compact, ws_trim
from turnloom.operators.turns import valid_turns
from turnloom.plans.segments import SEGMENT, segment_of
from turnloom.session import durable

# fixed values: list sizes, in list order
LIST_SIZES = {"profile": 10, "patterns": 12, "active_context": 8, "mistakes": 8, "behavioral_signals": 12}
# fixed values: what each list is filled with
PREFERENCES = (
    (("typescript",), "prefers_stack: TypeScript"),
    (("python",), "prefers_stack: Python"),
    (("openrouter",), "llm_provider_interest: OpenRouter"),
    (("apk",), "delivery_interest: Android APK"),
    (("local", "laptop"), "deployment_preference: local-first"),
)
BLOCKERS = (
    (("error", "throws", "failing"), "blocker_pattern: recurring debugging/errors"),
    (("not connected", "missing"), "blocker_pattern: missing integration surfaces"),
)
WORK = (r"(?i)\b(?:building|working on|creating|making|debugging|launching)", 70)
STUDY = (r"(?i)\b(?:study at|student at|from)", 50)
LEAST_CHARS = 3


def after_opening(text: Column, following: Column, opening: str, most: int) -> Column:
    """What follows the first opening phrase, trimmed; null without one. The phrase may end the text: white space runs on
    into the following text, as it does when the turns of a session are joined by line breaks."""
    body = f"([^.\\n]{{{LEAST_CHARS},{most}}})"
    own = F.get(F.regexp_extract_all(text, F.lit(java(rf"{opening}\s+{body}")), F.lit(1)), 0)
    open_end = text.rlike(java(rf"{opening}\s*\z"))
    next_ = F.when(open_end, F.get(F.regexp_extract_all(ws_trim(following), F.lit(java(rf"\A{body}")), F.lit(1)), 0))
    return ws_trim(F.coalesce(own, next_))


def with_following(turns: DataFrame, size: int = SEGMENT, chars: int = 200) -> DataFrame:
    """Adds ``following``: the beginning of the conversation's next text that is not blank, null after the last.

    Windows run within segments; what follows a segment comes from a table with one row per segment.
    """
    rows = turns.withColumn("seg", segment_of(F.col("turn"), size)).withColumn("_head", F.substring(ws_trim(F.col("text")), 1, chars))
    rows = rows.withColumn("_head", F.when(F.col("_head") != "", F.col("_head")))
    segments = rows.groupBy("conv_id", "seg").agg(F.min_by("_head", F.when(F.col("_head").isNotNull(), F.col("turn"))).alias("_first"))
    later = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
    segments = segments.select("conv_id", "seg", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    after = Window.partitionBy("conv_id", "seg").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumn("following", F.first("_head", ignorenulls=True).over(after)).join(segments, ["conv_id", "seg"])
    return found.withColumn("following", F.coalesce("following", "_later")).drop("_head", "_later", "seg")


def session_items(turns: DataFrame, frames: DataFrame) -> DataFrame:
    """(conv_id, five item arrays): what one session adds. Each turn is scanned with the beginning of the next, then combined."""
    low = F.lower("text")

    def seen(words) -> Column:
        cond = low.contains(words[0])
        for w in words[1:]:
            cond = cond | low.contains(w)
        return F.coalesce(F.bool_or(cond), F.lit(False))

    work, study = (after_opening(F.col("text"), F.col("following"), *phrase) for phrase in (WORK, STUDY))
    hit = with_following(valid_turns(turns)).withColumns({"work": work, "study": study})
    found = hit.groupBy("conv_id").agg(
        F.min_by("work", F.when(F.col("work").isNotNull(), F.col("turn"))).alias("work"),
        F.min_by("study", F.when(F.col("study").isNotNull(), F.col("turn"))).alias("study"),
        *[seen(words).alias(f"p{i}") for i, (words, _) in enumerate(PREFERENCES)],
        *[seen(words).alias(f"b{i}") for i, (words, _) in enumerate(BLOCKERS)],
    )

    def listed(*items: Column) -> Column:
        cleaned = F.transform(F.array_compact(F.array(*items)), lambda x: compact(x, 90))
        return F.array_distinct(F.filter(cleaned, lambda x: x != ""))

    return found.join(frames.select("conv_id", "domain", "intent"), "conv_id").select(
        "conv_id",
        listed(F.concat(F.lit("profile_fact: "), "study")).alias("profile"),
        listed(F.concat(F.lit("common_domain: "), "domain"), F.concat(F.lit("recent_intent: "), "intent")).alias("patterns"),
        listed(F.concat(F.lit("current_work: "), "work")).alias("active_context"),
        listed(*[F.when(F.col(f"b{i}"), F.lit(text)) for i, (_, text) in enumerate(BLOCKERS)]).alias("mistakes"),
        listed(*[F.when(F.col(f"p{i}"), F.lit(text)) for i, (_, text) in enumerate(PREFERENCES)]).alias("behavioral_signals"),
    )


def _without_repeats(items: DataFrame, size: int) -> DataFrame:
    """Shorten runs of equal sessions inside a segment, where that changes nothing.

    Take a session that adds m distinct items to a list of size L, m <= L. While it repeats, an item that was pushed stays:
    only other items of the session are pushed behind it, fewer than L. So each repetition either pushes an item for the
    first time in the run or changes nothing, and after m repetitions the list stands still. A run is therefore cut to
    max(m) + 1 sessions; a run with m > L for some list, where items push each other out for ever, is kept whole. The dropped
    sessions stay counted, so versions are right.
    """
    w = Window.partitionBy("user_id", "seg").orderBy("seq")
    rows = items.withColumn("seg", segment_of(F.col("seq"), size)).withColumn("_all", F.to_json(F.struct(*LIST_SIZES)))
    fresh = F.coalesce(F.lag("_all").over(w) != F.col("_all"), F.lit(True)).cast("long")
    rows = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    run = Window.partitionBy("user_id", "seg", "_run")
    sizes = {c: F.size(F.array_distinct(c)) for c in LIST_SIZES}
    settles = F.lit(True)
    for c, most in LIST_SIZES.items():
        settles = settles & (sizes[c] <= most)
    rows = rows.withColumns(
        {
            "_p": F.row_number().over(run.orderBy("seq")),
            "_len": F.count(F.lit(1)).over(run),
            "_end": F.max("seq").over(run),
        }
    )
    rows = rows.withColumn("_most", F.when(settles, F.greatest(*sizes.values()) + 1).otherwise(F.col("_len"))).filter(F.col("_p") <= F.col("_most"))
    last = F.col("_p") == F.col("_most")
    return rows.withColumns(
        {
            "n": F.when(last, F.col("_len") - F.col("_most") + 1).otherwise(F.lit(1)),
            "last_seq": F.when(last, F.col("_end")).otherwise(F.col("seq")),
        }
    )


def _push(target: list[str], added: list[str] | None, most: int) -> None:
    for item in added or ():
        if item not in target:
            target.append(item)
    if len(target) > most:
        del target[: len(target) - most]


def fold_lists(lists: dict[str, list[str]], added: dict[str, list[str]]) -> None:
    """Add absent items at the end, then drop from the front; a dropped item may come back later."""
    for name, size in LIST_SIZES.items():
        _push(lists[name], added[name], size)


BLOCKS_PER_CORE = 2
ENTRY = "user_id string, block int, name string, entry array<string>, exit array<string>"
#: What a user's sessions in one block come to.
FOLDED = "user_id string, block int, edge boolean, n long, last_seq long, " + ", ".join(f"{c}_alone array<string>, {c}_distinct array<string>" for c in LIST_SIZES)


def _sessions(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)


def _folded(rows: DataFrame) -> DataFrame:
    """A row for each user in each block: its sessions, and for each list what it holds after this block alone and the distinct
    items in order, null where they are more than the list holds. edge: the user may go on in the next or previous block."""
    schema = to_arrow_schema(schemas.struct(FOLDED))
    lists = list(LIST_SIZES.items())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(edge: bool) -> tuple:
            found = [x for (_, most), target, seen in zip(lists, alone, distinct, strict=True) for x in (target, None if len(seen) > most else list(seen))]
            return user, block, edge, n, last, *found

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        done, user, block, first = [], None, None, True
        alone, distinct, n, last = [], [], 0, 0
        for of, at, count, until, *added in _sessions(batches, ["user_id", "block", "n", "last_seq", *LIST_SIZES]):
            if block is None or of != user:
                if block is not None:
                    done.append(row(first))
                    first = False
                    if len(done) >= 1000:
                        yield batch_of(done)
                        done = []
                user, block, n = of, at, 0
                alone, distinct = [[] for _ in lists], [{} for _ in lists]
            n, last = n + count, until
            for i, (_, most) in enumerate(lists):
                _push(alone[i], added[i], most)
                if len(distinct[i]) <= most:
                    distinct[i].update(dict.fromkeys(added[i] or ()))
        if block is not None:
            done.append(row(True))
            yield batch_of(done)

    return rows.mapInArrow(fn, FOLDED)


def after_block(most: int, entry: list[str], alone: list[str], distinct: list[str] | None, known: dict) -> tuple[list[str], bool]:
    """What a list holds after a block, and whether that is certain.

    Nothing is dropped while entry and new items fit the list; then the new items follow the entry. Otherwise a run from that
    entry says it, or, before there is one, a guess does.
    """
    if not entry:
        return alone, True
    if distinct is not None:
        added = [x for x in distinct if x not in entry]
        if len(entry) + len(added) <= most:
            return entry + added, True
    if tuple(entry) in known:
        return known[tuple(entry)], True
    if known:  # what the latest run ended with: most lists forget what they began with
        return next(reversed(known.values())), False
    return (alone if distinct is None else (entry + added)[-most:]), False


def _chained(blocks: list, known: dict) -> tuple[dict, int, int, dict]:
    """What a user's blocks, in order, come to: lists, sessions, last seq; and the runs wanted, (block, list) with its entry.

    The first run wanted for a list starts from its true entry, so each round settles one more block of it at least.
    """
    lists, wanted, n = {c: [] for c in LIST_SIZES}, {}, 0
    for r in blocks:
        for c, most in LIST_SIZES.items():
            found, sure = after_block(most, lists[c], r[f"{c}_alone"], r[f"{c}_distinct"], known.get((r["user_id"], r["block"], c), {}))
            if not sure:
                wanted[r["block"], c] = lists[c]
            lists[c] = list(found)
        n += r["n"]
    return lists, n, blocks[-1]["last_seq"], wanted


def _runs(rows: DataFrame, wanted: dict[tuple, list[str]]) -> DataFrame:
    """(user_id, block, name, entry, exit): blocks of rows folded from the entries wanted, {(user_id, block, list): entry}."""
    schema = to_arrow_schema(schemas.struct(ENTRY))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict = {}
        for (of, at, c), entry in wanted.items():
            mine.setdefault((of, at), []).append((list(LIST_SIZES).index(c), c, entry, list(entry)))
        met = set()
        for of, at, *added in _sessions(batches, ["user_id", "block", *LIST_SIZES]):
            if (of, at) in mine:
                met.add((of, at))
                for i, c, _, target in mine[of, at]:
                    _push(target, added[i], LIST_SIZES[c])
        out = [(*key, c, entry, target) for key in met for _, c, entry, target in mine[key]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(fn, ENTRY)


def fold_user_memory(items: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Fold sessions items(user_id STRING, seq, five arrays) into one memory row per user.

    The lists depend on the order of all sessions. Sessions are dealt in order into blocks, ranges of (user, seq) of equal size,
    at most BLOCKS_PER_CORE for each core and about `size` sessions at least, which are folded in parallel and row by row. Most users
    lie within a block and are done then. A user that goes on in the next block is the last of one and the first of another, so
    there are at most two such rows for each block, and these are chained on the driver. Where a block drops items its end
    depends on the entry: it is folded again from the entry that the chain found, until all entries are those that were run. The
    rounds are never more than the blocks of one user, so all runs together take no longer than one after the other. Runs of
    equal sessions are combined first, which is what a very frequent user mostly consists of. The rounds run when this is called.
    """
    spark = items.sparkSession
    rows = durable(_without_repeats(items, size).select("user_id", "seq", "last_seq", "n", *LIST_SIZES))
    blocks = max(1, min(BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-rows.count() // size)))
    ordered = rows.repartitionByRange(blocks, "user_id", "seq").sortWithinPartitions("user_id", "seq")
    rows = durable(ordered.withColumn("block", F.spark_partition_id()))
    folded = durable(_folded(rows))
    edges = {}
    for r in folded.filter("edge").orderBy("block").collect():
        edges.setdefault(r["user_id"], []).append(r)
    known, ended = {}, []
    open_ = list(edges)
    while open_:
        wanted, left = {}, []
        for user in open_:
            lists, n, last, runs = _chained(edges[user], known)
            wanted |= {(user, *of): entry for of, entry in runs.items()}
            if runs:
                left.append(user)
            else:
                ended.append((user, *lists.values(), n, last))
        if wanted:
            again = rows.filter(F.col("block").isin(sorted({block for _, block, _ in wanted})))
            for r in _runs(again, wanted).collect():
                known.setdefault((r["user_id"], r["block"], r["name"]), {})[tuple(r["entry"])] = r["exit"]
        open_ = left
    within = folded.filter("NOT edge").select("user_id", *[F.col(f"{c}_alone").alias(c) for c in LIST_SIZES], "n", "last_seq")
    across = spark.createDataFrame(ended, "user_id string, " + ", ".join(f"{c} array<string>" for c in LIST_SIZES) + ", n long, last_seq long")
    return within.unionByName(across).select("user_id", *LIST_SIZES, F.col("n").cast("int").alias("version"), "last_seq")


def ingest_sessions(turns: DataFrame, frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """User memories from sessions(conv_id, user_id, seq)."""
    items = session_items(turns, frames).join(sessions, "conv_id")
    return fold_user_memory(items.select("user_id", "seq", *LIST_SIZES))


def memory_context() -> Column:
    """Titled bullet sections of a user memory row; empty lists are skipped."""
    titles = {
        "profile": "Profile",
        "patterns": "Patterns",
        "active_context": "Active context",
        "mistakes": "Recurring blockers",
        "behavioral_signals": "Behavioral signals",
    }

    def section(column: str, title: str) -> Column:
        bullets = F.array_join(F.transform(column, lambda v: F.concat(F.lit("- "), v)), "\n")
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{title}:\n"), bullets))

    return F.concat_ws("\n", *[section(c, t) for c, t in titles.items()])


def frame_to_source(n_turns: Column) -> Column:
    """(title, content) of a memory frame row as a memory source."""

    def part(title: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{title}: "), F.array_join(column, ", ")))

    content = F.concat_ws(
        "\n",
        F.concat(
            F.lit("Domain: "), "domain", F.lit(" | Intent: "), "intent", F.lit(" | State: "), "state"
        ),
        F.concat(F.lit("Task: "), "task"),
        F.when(F.coalesce("user_goal", F.lit("")) != "", F.concat(F.lit("Goal: "), "user_goal")),
        part("Entities", "entities"),
        part("Constraints", "constraints"),
        part("Unresolved", "unresolved"),
        part("Risk", "risk"),
    )
    title = F.concat(F.lit("Session memory — "), "domain", F.lit(" ("), n_turns.cast("string"), F.lit(" turns)"))
    return F.struct(title.alias("title"), content.alias("content"))
