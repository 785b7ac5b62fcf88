"""History compression: a summary line, a few relevant turns, and rescued turns that hold missing facts.

A request is one conversation: its last user turn is the current message, the valid turns before it
the history. A conversation that fits one segment is gathered into one bounded array (one shuffle of
the text) and everything, classification included, is computed on that row. Longer conversations are
spread over their segments: their turns keep the shuffle key (conversation, segment), conversation-level
values come back through a join on that key, and the small tables in between are checkpointed. What is
kept per conversation is bounded either way (at most 8 turns, 12 facts, 10 entities).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.facts import (
    contained_count,
    entity_budget,
    extract_facts,
    infer_constraints,
    infer_unresolved,
    missing_from,
    rank_facts,
    user_goal,
)
from turnloom.functions.sqltext import NO_STRINGS, by_domain, q
from turnloom.functions.text import compact_sentence, est_tokens, saved_tokens
from turnloom.functions.vocab import DEFAULT, DOMAIN_LEADS, HIGH_VALUE_DOMAINS, LABEL, OTHER_DOMAIN_LEAD, Vocabulary
from turnloom.operators.classify import (
    classify,
    label_frames,
    last_frames,
    lift_arrays,
    plugin_list,
    protected_gate,
)
from turnloom.operators.hard_facts import hard_facts, hard_facts_of
from turnloom.operators.relevance import drop_distractors, scored_messages, scored_turns
from turnloom.operators.signals import Layout
from turnloom.operators.turns import unique_messages, valid_turns
from turnloom.plans.segments import SEGMENT, segment_of, segment_offsets, top_per_group
from turnloom.session import durable

KEEP_WHOLE = 4
FOCUS_SCORE = 2.5
ANCHOR_SCORE = 4
ANCHORS = 2
RESCUES = 2
USER_BONUS = 0.75
WHOLE = f"(n <= {KEEP_WHOLE} OR protected)"  # conversations that are passed on unchanged
MESSAGES = "array<struct<pos:bigint,role:string,text:string>>"

# why turns were kept; queries and their SQL take the wording from here
ALL_KEPT = "Nothing to shorten: at most four turns."
ALL_PROTECTED = "Left unchanged: a protected subject."
RESCUED = "Turns brought back for values the rest had lost ({n}): {facts}"
SUMMARY_ALONE = "Only the summary is left."
WITH_RECENT = "Summary and the latest turns that matter."
WITH_ANCHORS = "Summary and older turns that matter."
NO_MODEL = "No summary of a model; shortened by rules."


@dataclass
class Compression:
    """``turns``: the compressed turns in order. ``summary``: one row of measures per conversation."""

    turns: DataFrame
    summary: DataFrame


def lower_set(items: str) -> str:
    return f"array_distinct(transform({items}, x -> lower(x)))"


def requests(turns: DataFrame, frames: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per conversation: its last frame, the current text, sizes, and the facts of the current text."""
    heads = last_frames(frames)
    user = valid_turns(turns).filter(F.col("role") == "user")
    latest = user.groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest_text"))
    rows = heads.join(latest, "conv_id").select(
        "conv_id",
        F.col("turn").alias("current_turn"),
        "intent",
        "state",
        "domain",
        "risk",
        "latest_text",
        (F.col("pos") + 1).alias("n"),
        F.col("context_chars").alias("original_chars"),
    )
    return with_latest_facts(rows, vocab)


def with_latest_facts(rows: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The best facts of the current text, lower-cased."""
    rows = rows.withColumn("latest_found", extract_facts("latest_text", "domain", vocab))
    return rows.withColumn("latest_best", rank_facts("latest_found", "domain", 8)).select(
        "*", F.expr(lower_set("latest_best")).alias("latest_facts")
    ).drop("latest_found", "latest_best")


def turn_rows(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Valid turns, shuffled once by (conversation, segment); every later pass starts from this shuffle."""
    return (
        valid_turns(turns)
        .select("conv_id", segment_of(F.col("turn"), size).alias("seg"), "turn", "role", "text")
        .repartition("conv_id", "seg")
    )


def segment_heads(turns: DataFrame, heads: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Conversation-level columns repeated once per segment, with the segment's offset."""
    keyed = valid_turns(turns).select("conv_id", segment_of(F.col("turn"), size).alias("seg"))
    sizes = keyed.groupBy("conv_id", "seg").agg(F.count(F.lit(1)).alias("n"))
    offsets = segment_offsets(sizes, ["conv_id"]).drop("n_rows")
    return offsets.join(heads, "conv_id")


def placed_rows(rows: DataFrame, seg_heads: DataFrame) -> DataFrame:
    """Turns of the request with their 0-based position; turns after the current one fall away."""
    w = Window.partitionBy("conv_id", "seg").orderBy("turn")
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    joined = ranked.join(seg_heads, ["conv_id", "seg"])
    return (
        joined.filter(F.col("turn") <= F.col("current_turn"))
        .withColumn("pos", F.col("offset") + F.col("_rn") - 1)
        .drop("_rn", "offset")
    )


def focus_limit(domain: str = "domain") -> str:
    return f"IF({_high(domain)}, 8, 6)"


def recent_count(domain: str = "domain") -> str:
    return f"IF({_high(domain)}, 4, 2)"


def _high(domain: str) -> str:
    return f"{domain} IN ({', '.join(map(q, HIGH_VALUE_DOMAINS))})"


def focus_score(base: str, facts: str, low: str, role: str, pos: str) -> str:
    """Relevance with known facts, a bonus for the user's turns and up to a point for late ones; n is the row's."""
    bonus = f"IF({role} = 'user', {USER_BONUS}D, 0.0D)"
    return f"({base} + 3 * {contained_count(facts, low)} + {bonus} + {pos} / greatest(1, n))"


def anchor_score(base: str, facts: str, low: str, pos: str) -> str:
    return f"({base} + 3 * {contained_count(facts, low)} + {pos} / greatest(1, n))"


def best_first(score: Column, threshold: float) -> Column:
    """Score where it reaches the threshold, else null: sorts below every qualifying turn."""
    return F.when(score >= threshold, score)


def top_focus(scored: DataFrame, limit: int) -> DataFrame:
    """The best turns per conversation; without a qualifying turn these are its last ones."""
    order = [F.col("rank_score").desc_nulls_last(), F.col("pos").desc()]
    return top_per_group(scored, ["conv_id"], order, limit)


def messages_of(items: str) -> str:
    """Items as (pos, role, text), in turn order."""
    return f"array_sort(transform({items}, r -> struct(r.pos AS pos, r.role AS role, r.text AS text)))"


def chosen(best: str, limit: str) -> str:
    """Turn order list of the chosen turns from a best-first list of (pos, role, text, ok)."""
    good = f"filter(slice({best}, 1, {limit}), r -> r.ok)"
    return f"IF(size({good}) > 0, {unique_messages(messages_of(good))}, {messages_of(f'slice({best}, 1, {limit})')})"


def ranked_messages(scored: str, score: str, threshold: float, only_ok: bool = False) -> str:
    """Best-first list of (pos, role, text, ok) from scored messages; ``score`` is the score of a message m."""
    valued = f"transform({scored}, m -> struct({score} AS v, m.pos AS pos, m.role AS role, m.text AS text))"
    ok = f"m.v >= {threshold}D"
    entry = (
        f"struct(IF({ok}, 0, 1) AS below, IF({ok}, -m.v, 0.0D) AS neg_score, -m.pos AS neg_pos, m.pos AS pos, "
        f"m.role AS role, m.text AS text, {ok} AS ok)"
    )
    entries = f"array_sort(transform({valued}, m -> {entry}))"
    return f"filter({entries}, m -> m.ok)" if only_ok else entries


def recent_tail(focus: str, count: str) -> str:
    return f"slice({focus}, greatest(1, size({focus}) - {count} + 1), {count})"


def free_anchors(ranked: str, recent: str) -> str:
    """The two best anchor candidates that are not among the recent turns, in turn order."""
    free = f"filter({ranked}, m -> NOT array_contains({_positions(recent)}, m.pos))"
    return unique_messages(messages_of(f"slice({free}, 1, {ANCHORS})"))


def with_memory(rows: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add the memory frame columns to rows with latest_text, fact_text, domain and intent."""
    domain, intent = F.col("domain"), F.col("intent")
    rows = rows.withColumn("found_facts", extract_facts("fact_text", "domain", vocab))
    ranked = rank_facts("found_facts", "domain", 10)
    return rows.withColumns(
        {
            "task": compact_sentence(F.col("latest_text"), 96),
            "user_goal": user_goal(F.col("latest_text"), domain, intent),
            "entities": F.slice(ranked, F.lit(1), entity_budget(domain, intent)),
            "constraints": infer_constraints("fact_text", "domain"),
            "unresolved": infer_unresolved("fact_text", "domain", "intent"),
        }
    ).drop("fact_text", "found_facts")


def with_fact_sets(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("memory_facts", F.expr(lower_set("concat(entities, constraints, unresolved)")))
    return rows.withColumn("all_facts", F.array_union("latest_facts", "memory_facts"))


def is_whole() -> Column:
    return F.expr(WHOLE)


# --- conversations of one segment: one row each --------------------------------------------------


def long_segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame | None:
    """(conv_id, seg) of conversations longer than one segment; None when there are none.

    Reads only the turn numbers. The result has one row per ``size`` turns of a long conversation.
    """
    keys = valid_turns(turns).select("conv_id", segment_of(F.col("turn"), size).alias("seg"))
    top = keys.agg(F.max("seg").alias("m")).first()["m"]
    if top is None or top == 0:
        return None
    segs = keys.distinct()
    longs = segs.groupBy("conv_id").agg(F.max("seg").alias("m")).filter(F.col("m") > 0).select("conv_id")
    return durable(segs.join(longs, "conv_id"))


def conversation_rows(turns: DataFrame, layout: Layout, size: int = SEGMENT, longs: DataFrame | None = None) -> DataFrame:
    """One row per short conversation with a user turn: its turns up to the current one, with packed features."""
    rows = valid_turns(turns).withColumn("seg", segment_of(F.col("turn"), size))
    if longs is not None:
        rows = rows.join(longs, ["conv_id", "seg"], "left_anti")
    packed = layout.features(rows, keep=("conv_id", "turn", "role", "text"))
    grouped = packed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "feat"))).alias("all"),
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("current_turn"),
    )
    request = grouped.filter(F.col("current_turn").isNotNull()).select(
        "conv_id", "current_turn", F.expr("filter(`all`, m -> m.turn <= current_turn)").alias("msgs")
    )
    return request.withColumn("feats", F.expr("transform(msgs, m -> m.feat)"))


def plugin_frames(turns: DataFrame, frames: DataFrame | None, vocab: Vocabulary, plugins, size: int) -> tuple:
    """Frames and the plugins that are left to apply: a table of plugins is joined while the turns are classified."""
    if not isinstance(plugins, DataFrame):
        return frames, plugins
    return (classify(turns, plugins, vocab, size=size) if frames is None else frames), None


FRAME_COLUMNS = ("intent", "state", "domain", "risk")


def short_requests(
    turns: DataFrame, frames: DataFrame | None, vocab: Vocabulary, plugins, size: int, longs: DataFrame | None
) -> DataFrame:
    """Request columns plus ``msgs``; frames are computed on the row unless given."""
    layout = Layout(vocab, plugin_list(plugins))
    rows = conversation_rows(turns, layout, size, longs)
    if frames is None:
        lifted = lift_arrays(rows, layout)
        framed = label_frames(lifted, layout, ("conv_id", "current_turn", "msgs"))
    else:
        given = last_frames(frames).select("conv_id", "context_chars", "signals", "confidence", *FRAME_COLUMNS)
        framed = rows.drop("feats").join(given, "conv_id")
    framed = framed.withColumns(
        {
            "n": F.size("msgs").cast("long"),
            "latest_text": F.element_at("msgs", -1)["text"],
            "original_chars": F.col("context_chars"),
        }
    ).drop("context_chars")
    return with_latest_facts(framed, vocab)


def short_memory(rows: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Score the turns of each row, choose the focus turns, and derive the memory frame from them."""
    rows = rows.withColumn("scored", F.expr(scored_messages("msgs", "domain", vocab)))
    best = ranked_messages("scored", focus_score("m.base", "latest_facts", "m.low", "m.role", "m.pos"), FOCUS_SCORE)
    rows = rows.withColumn("best", F.expr(f"slice({best}, 1, 8)"))
    return with_memory(rows.withColumn("fact_text", F.expr(_fact_text())).drop("best"), vocab)


def _fact_text() -> str:
    """The current text and the focus turns of the best-first list ``best``."""
    texts = f"transform({chosen('best', focus_limit())}, m -> m.text)"
    return f"concat(latest_text, {q(chr(10))}, array_join({texts}, {q(chr(10))}))"


def short_compression(memory: DataFrame, label: str = LABEL) -> DataFrame:
    """One row per short conversation with the compressed messages and all measures."""
    rows = with_fact_sets(memory)
    recent = ranked_messages("scored", focus_score("m.base", "all_facts", "m.low", "m.role", "m.pos"), FOCUS_SCORE)
    anchors = ranked_messages("scored", anchor_score("m.base", "memory_facts", "m.low", "m.pos"), ANCHOR_SCORE, only_ok=True)
    rows = rows.withColumns({"r": F.expr(f"slice({recent}, 1, 6)"), "a": F.expr(f"slice({anchors}, 1, 6)")})
    rows = with_picked(with_recent_and_anchors(rows), label)
    rows = rows.withColumn("all_text", F.expr("array_join(transform(msgs, m -> m.text), ' ')"))
    rows = rows.withColumn("hard_facts", F.when(~is_whole(), hard_facts_of("all_text", "domain"))).drop("all_text")
    rows = with_missing(rows)
    free = f"filter(scored, m -> NOT array_contains({_positions('picked')}, m.pos))"
    covered = "size(filter(missing, f -> contains(m.low, lower(f))))"
    entries = f"transform({free}, m -> struct(-{covered} AS neg, m.pos AS pos, m.role AS role, m.text AS text))"
    best = messages_of(f"slice(filter(array_sort({entries}), m -> m.neg < 0), 1, {RESCUES})")
    rows = rows.withColumn("rescue", F.expr(f"IF(size(missing) > 0, {best}, CAST(array() AS {MESSAGES}))"))
    everything = "transform(msgs, (m, i) -> struct(CAST(i AS BIGINT) AS pos, m.role AS role, m.text AS text))"
    rows = with_result(rows, label)
    return rows.withColumn("compressed", F.expr(f"IF({WHOLE}, {everything}, compressed)"))


def with_recent_and_anchors(rows: DataFrame) -> DataFrame:
    """The message lists ``recent`` and ``anchors`` from the best-first lists ``r`` and ``a``."""
    count = recent_count()
    rows = rows.withColumn("_last", F.expr(chosen("r", f"{count} + 2")))
    rows = rows.withColumn("recent", F.expr(recent_tail("_last", count))).drop("_last", "r")
    return rows.withColumn("anchors", F.expr(free_anchors("a", "recent"))).drop("a")


# --- long conversations: their turns stay spread over segments ------------------------------------


def long_memory(
    turns: DataFrame, heads: DataFrame, rows: DataFrame, vocab: Vocabulary = DEFAULT, size: int = SEGMENT
) -> DataFrame:
    """Request columns plus the memory frame, for conversations of several segments."""
    slim = heads.select("conv_id", "current_turn", "domain", "n", "latest_facts")
    scored = scored_turns(placed_rows(rows, segment_heads(turns, slim, size)), vocab)
    score = F.expr(focus_score("base_score", "latest_facts", "low", "role", "pos"))
    ranked = scored.select("conv_id", "pos", "role", "text", best_first(score, FOCUS_SCORE).alias("rank_score"))
    best = top_focus(ranked, 8)
    focus = best.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "pos", "role", "text", F.col("rank_score").isNotNull().alias("ok")))
        ).alias("best")
    )
    joined = heads.join(focus, "conv_id")
    return with_memory(joined.withColumn("fact_text", F.expr(_fact_text())).drop("best"), vocab)


def memory_frames(
    turns: DataFrame,
    frames: DataFrame | None = None,
    vocab: Vocabulary = DEFAULT,
    plugins=None,
    size: int = SEGMENT,
) -> DataFrame:
    """One memory frame per conversation: task, goal, entities, constraints, open questions, risk."""
    frames, plugins = plugin_frames(turns, frames, vocab, plugins, size)
    longs = long_segments(turns, size)
    short = short_memory(short_requests(turns, frames, vocab, plugins, size, longs), vocab)
    out = short.select(*MEMORY_COLUMNS)
    if longs is None:
        return out
    long_turns, heads = _long_inputs(turns, frames, vocab, plugins, size, longs)
    return out.unionByName(long_memory(long_turns, heads, turn_rows(long_turns, size), vocab, size).select(*MEMORY_COLUMNS))


MEMORY_COLUMNS = [
    "conv_id", "current_turn", "n", "intent", "state", "domain", "risk", "task", "user_goal", "entities", "constraints",
    "unresolved",
]


def _long_inputs(turns, frames, vocab, plugins, size, longs) -> tuple[DataFrame, DataFrame]:
    """Turns and checkpointed request rows of the long conversations."""
    keyed = valid_turns(turns).withColumn("seg", segment_of(F.col("turn"), size))
    long_turns = keyed.join(longs, ["conv_id", "seg"], "left_semi").drop("seg")
    if frames is None:
        frames = classify(long_turns, plugins, vocab, size=size)
    return long_turns, durable(requests(long_turns, frames, vocab))


def summary_line(label: str = LABEL) -> str:
    """The summary text of a memory frame, as SQL text; empty parts are left out."""
    task = "CASE WHEN task <> '' THEN task WHEN user_goal <> '' THEN user_goal ELSE 'Follow the active conversation.' END"
    lead = by_domain("domain", {name: q(text) for name, text in DOMAIN_LEADS.items()}, q(OTHER_DOMAIN_LEAD))

    def part(title: str, column: str) -> str:
        return f"IF(size({column}) > 0, concat({q(title + ': ')}, array_join({column}, ', '), '.'), NULL)"

    parts = [
        f"concat({q(label + ' summary: ')}, {lead}, {task}, '.')",
        part("Key facts", "entities"),
        part("Important constraints", "constraints"),
        part("Still unresolved", "unresolved"),
        part("Risk flags", "risk"),
    ]
    return f"concat_ws(' ', {', '.join(parts)})"


def _tokens(messages: str) -> str:
    return f"CAST(ceil(aggregate({messages}, 0L, (a, m) -> a + length(m.text)) / 4) AS BIGINT)"


def _positions(messages: str) -> str:
    return f"transform({messages}, p -> p.pos)"


def recent_and_anchor_turns(
    turns: DataFrame, memory: DataFrame, vocab: Vocabulary = DEFAULT, size: int = SEGMENT, rows: DataFrame | None = None
) -> DataFrame:
    """(conv_id, recent, anchors): both bounded message lists in turn order."""
    rows = turn_rows(turns, size) if rows is None else rows
    slim = with_fact_sets(memory).select("conv_id", "current_turn", "domain", "n", "memory_facts", "all_facts")
    scored = scored_turns(placed_rows(rows, segment_heads(turns, slim, size)), vocab)
    recent = best_first(F.expr(focus_score("base_score", "all_facts", "low", "role", "pos")), FOCUS_SCORE)
    anchor = best_first(F.expr(anchor_score("base_score", "memory_facts", "low", "pos")), ANCHOR_SCORE)
    kinds = F.array(
        F.struct(F.lit("recent").alias("kind"), recent.alias("s")),
        F.struct(F.lit("anchor").alias("kind"), anchor.alias("s")),
    )
    keep = F.filter(kinds, lambda k: (k["kind"] == "recent") | k["s"].isNotNull())
    candidates = scored.select("conv_id", "domain", "pos", "role", "text", F.explode(keep).alias("k")).select(
        "conv_id", "domain", "pos", "role", "text", F.col("k.kind").alias("kind"), F.col("k.s").alias("rank_score")
    )
    # two anchors besides at most four recent turns: six of each kind are enough
    order = [F.col("rank_score").desc_nulls_last(), F.col("pos").desc()]
    best = top_per_group(candidates, ["conv_id", "kind"], order, 6)
    entry = F.struct("rank", "pos", "role", "text", F.col("rank_score").isNotNull().alias("ok"))
    grouped = best.groupBy("conv_id").agg(
        F.first("domain").alias("domain"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "recent", entry))).alias("r"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "anchor", entry))).alias("a"),
    )
    return with_recent_and_anchors(grouped).select("conv_id", "recent", "anchors")


def rescue_turns(
    turns: DataFrame, wanted: DataFrame, size: int = SEGMENT, rows: DataFrame | None = None
) -> DataFrame:
    """(conv_id, rescue): up to two turns that cover most missing facts, from wanted(conv_id, current_turn, missing, kept)."""
    rows = turn_rows(turns, size) if rows is None else rows
    placed = placed_rows(rows, segment_heads(turns, wanted, size)).filter(
        ~F.array_contains("kept", F.col("pos"))
    )
    low = F.lower("text")
    coverage = F.size(F.filter("missing", lambda f: low.contains(F.lower(f))))
    covered = placed.select("conv_id", "pos", "role", "text", coverage.alias("coverage")).filter(F.col("coverage") > 0)
    best = top_per_group(covered, ["conv_id"], [F.col("coverage").desc(), F.col("pos").asc()], RESCUES)
    return best.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rescue"))


def with_picked(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Choose the first candidate that is small enough: summary with anchors and recent turns, without anchors, alone."""
    rows = rows.withColumns({"summary_text": F.expr(summary_line(label)), "original_tokens": est_tokens(F.col("original_chars"))})
    head = "array(struct(-1L AS pos, 'assistant' AS role, summary_text AS text))"
    ratio_limit = f"IF({_high('domain')}, 0.62D, 0.5D)"

    def fits(column: str) -> str:
        return f"{_tokens(column)} / greatest(1, original_tokens) <= {ratio_limit}"

    rows = rows.withColumns(
        {
            "with_anchors": F.expr(unique_messages(f"concat({head}, anchors, recent)")),
            "with_recent": F.expr(unique_messages(f"concat({head}, recent)")),
        }
    )
    fitting = f"CASE WHEN {fits('with_anchors')} THEN with_anchors WHEN {fits('with_recent')} THEN with_recent ELSE {head} END"
    rows = rows.withColumns({"picked": F.expr(fitting), "_bare": F.expr(unique_messages("concat(anchors, recent)"))})
    last_four = "slice(_bare, greatest(1, size(_bare) - 3), 4)"
    too_big = f"{_tokens('picked')} >= original_tokens"
    rows = rows.withColumn("picked", F.expr(f"IF({too_big}, {last_four}, picked)"))
    return rows.drop("with_anchors", "with_recent", "_bare")


def with_missing(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("hard_facts", F.expr(f"coalesce(hard_facts, {NO_STRINGS})"))
    low_text = "lower(array_join(transform(picked, m -> m.text), ' '))"
    return rows.withColumn("missing", F.expr(missing_from("hard_facts", low_text)))


def with_result(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Insert the rescued turns after the head and measure the outcome."""
    rest = "slice(picked, 2, greatest(0, size(picked) - 1))"
    final = unique_messages(f"concat(slice(picked, 1, 1), rescue, {rest})")
    rows = rows.withColumn("compressed", F.expr(f"IF(size(rescue) > 0, {final}, picked)"))
    retained = "size(filter(compressed, m -> m.role <> 'assistant' OR m.text <> summary_text))"
    keeps_recent = f"exists(compressed, m -> array_contains({_positions('recent')}, m.pos))"
    before, between = RESCUED.split("{n}")[0], RESCUED.split("{n}")[1].split("{facts}")[0]
    listed = f"concat({q(before)}, CAST(size(rescue) AS STRING), {q(between)}, array_join(slice(missing, 1, 3), ', '))"
    rescue_reason = f"IF(size(rescue) > 0, {listed}, NULL)"
    shape_reason = (
        f"CASE WHEN size(compressed) = 1 THEN {q(SUMMARY_ALONE)} WHEN {keeps_recent} THEN {q(WITH_RECENT)} "
        f"ELSE {q(WITH_ANCHORS)} END"
    )
    whole_reason = f"IF(n <= {KEEP_WHOLE}, {q(ALL_KEPT)}, {q(ALL_PROTECTED)})"
    tokens = f"IF({WHOLE}, original_tokens, {_tokens('compressed')})"
    return rows.withColumns(
        {
            "kept_reasons": F.expr(
                f"IF({WHOLE}, array({whole_reason}), array_compact(array({rescue_reason}, {shape_reason})))"
            ),
            "dropped_count": F.expr(f"CAST(IF({WHOLE}, 0, greatest(0, n - {retained})) AS BIGINT)"),
            "compressed_tokens": F.expr(tokens),
            "tokens_saved": F.expr(f"greatest(0L, original_tokens - {tokens})"),
            "n_compressed": F.expr(f"CAST(IF({WHOLE}, n, size(compressed)) AS BIGINT)"),
        }
    )


SUMMARY_COLUMNS = [
    *MEMORY_COLUMNS, "protected", "kept_reasons", "dropped_count", "original_tokens", "compressed_tokens",
    "tokens_saved", "n_compressed",
]


def gated(rows: DataFrame, protect: bool) -> DataFrame:
    if not protect:
        return rows.withColumn("protected", F.lit(False))
    return protected_gate(rows).drop("compress_allowed", "monetise_allowed", "retention")


def exploded(rows: DataFrame) -> DataFrame:
    """The compressed messages as rows in order.

    The arrays are never empty; the outer form only keeps Spark from adding a size filter, which it
    would push below (and so evaluate together with) every expression the array is built from.
    """
    return rows.select("conv_id", F.posexplode_outer("compressed").alias("out_pos", "m")).select(
        "conv_id", F.col("out_pos").cast("long").alias("out_pos"), "m.pos", "m.role", "m.text"
    )


def compress(
    turns: DataFrame,
    frames: DataFrame | None = None,
    protect: bool = True,
    vocab: Vocabulary = DEFAULT,
    plugins=None,
    label: str = LABEL,
    size: int = SEGMENT,
) -> Compression:
    """Compress every conversation up to its last user turn.

    With ``protect`` medical, legal and crisis conversations are passed on unchanged; without it
    they are compressed like any other. Conversations of at most four turns are kept whole.
    """
    frames, plugins = plugin_frames(turns, frames, vocab, plugins, size)
    longs = long_segments(turns, size)
    requests_ = gated(short_requests(turns, frames, vocab, plugins, size, longs), protect)
    short = short_compression(short_memory(requests_, vocab), label)
    result = Compression(exploded(short), short.select(*SUMMARY_COLUMNS))
    if longs is None:
        return result
    rest = _compress_long(turns, frames, protect, vocab, plugins, label, size, longs)
    return Compression(result.turns.unionByName(rest.turns), result.summary.unionByName(rest.summary))


def _compress_long(turns, frames, protect, vocab, plugins, label, size, longs) -> Compression:
    long_turns, heads = _long_inputs(turns, frames, vocab, plugins, size, longs)
    rows = turn_rows(long_turns, size)
    memory = gated(long_memory(long_turns, heads, rows, vocab, size), protect)
    picked = recent_and_anchor_turns(long_turns, memory, vocab, size, rows)
    work = durable(with_picked(memory.join(picked, "conv_id"), label))

    compressed_heads = work.filter(~is_whole()).select("conv_id", "current_turn", "domain")
    facts = hard_facts(placed_rows(rows, segment_heads(long_turns, compressed_heads, size)))
    work = durable(with_missing(work.join(facts, "conv_id", "left")))
    wanted = work.filter(~is_whole() & (F.size("missing") > 0)).select(
        "conv_id", "current_turn", "missing", F.expr(_positions("picked")).alias("kept")
    )
    rescued = rescue_turns(long_turns, wanted, size, rows)
    work = work.join(rescued, "conv_id", "left").withColumn("rescue", F.coalesce("rescue", F.array().cast(MESSAGES)))
    done = with_result(work, label)

    whole_heads = work.filter(is_whole()).select("conv_id", "current_turn")
    kept_turns = placed_rows(rows, segment_heads(long_turns, whole_heads, size)).select(
        "conv_id", F.col("pos").alias("out_pos"), "pos", "role", "text"
    )
    return Compression(
        turns=exploded(done.filter(~is_whole())).unionByName(kept_turns), summary=done.select(*SUMMARY_COLUMNS)
    )


def compress_with_summary(
    turns: DataFrame,
    frames: DataFrame,
    summaries: DataFrame,
    vocab: Vocabulary = DEFAULT,
    label: str = LABEL,
    size: int = SEGMENT,
) -> Compression:
    """Compression around a model's summary(conv_id, summary); a null or missing one means the rule path.

    The summary message carries the hard facts of the on-topic turns; the last turns stay verbatim, four
    more when sales or support conversations would shrink by more than half.
    """
    heads = requests(turns, frames, vocab).join(summaries, "conv_id", "left")
    modelled = heads.filter((F.col("n") > KEEP_WHOLE) & F.col("summary").isNotNull())
    rows = turn_rows(turns, size)
    seg = segment_heads(turns, modelled.select("conv_id", "current_turn", "domain", "n"), size)
    placed = placed_rows(rows, seg)

    on_topic = drop_distractors(valid_turns(turns), vocab)
    topic_heads = modelled.select("conv_id", "current_turn", "domain")
    # positions are counted again among the on-topic turns
    facts = hard_facts(placed_rows(turn_rows(on_topic, size), segment_heads(on_topic, topic_heads, size)))

    high_context = F.col("domain").isin("sales", "customer_support")
    keep = F.when(high_context, F.lit(6)).otherwise(F.lit(4))
    # 6 + 4 last turns are the most any branch needs; positions count from the end
    tail = placed.filter(F.col("n") - F.col("pos") <= keep + 4)
    tails = tail.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("tail"))
    suffix = F.when(
        F.size("hard_facts") > 0, F.concat(F.lit(" [Key facts: "), F.array_join("hard_facts", "; "), F.lit("]"))
    ).otherwise(F.lit(""))
    text = F.concat(F.lit(f"[{label} Memory] "), F.col("summary"), F.coalesce(suffix, F.lit("")))
    work = modelled.join(tails, "conv_id").join(facts, "conv_id", "left").withColumn("keep", keep)
    head = "array(struct(-1L AS pos, 'assistant' AS role, summary_text AS text))"
    recent = "filter(tail, m -> n - m.pos <= keep)"
    work = work.withColumn("summary_text", text)
    original = est_tokens(F.col("original_chars"))
    work = work.withColumns({"short": F.expr(unique_messages(f"concat({head}, {recent})")), "long": F.expr(unique_messages(f"concat({head}, tail)"))})
    reduction = 1 - F.expr(_tokens("short")) / F.greatest(F.lit(1), original)
    limit = F.when(high_context, F.lit(0.5)).otherwise(F.lit(0.8))
    work = work.withColumn("compressed", F.when(reduction > limit, F.col("long")).otherwise(F.col("short")))
    memory = memory_frames(turns.join(modelled.select("conv_id"), "conv_id", "left_semi"), frames, vocab, size=size)
    compressed = F.expr(_tokens("compressed"))
    measured = work.select(
        "conv_id",
        F.array(F.concat(F.lit("Model summary; turns kept as they were: "), (F.size("compressed") - 1).cast("string"))).alias("kept_reasons"),
        F.greatest(F.lit(0), F.col("n") - F.least(F.col("keep"), F.col("n"))).cast("long").alias("dropped_count"),
        original.alias("original_tokens"),
        compressed.alias("compressed_tokens"),
        saved_tokens(original, compressed).alias("tokens_saved"),
        F.size("compressed").cast("long").alias("n_compressed"),
        "compressed",
    )
    done = memory.join(measured, "conv_id").withColumn("method", F.lit("model"))
    model_turns = done.select("conv_id", F.posexplode_outer("compressed").alias("out_pos", "m")).select(
        "conv_id", F.col("out_pos").cast("long").alias("out_pos"), "m.pos", "m.role", "m.text"
    )

    is_model = modelled.select("conv_id")
    others = turns.join(is_model, "conv_id", "left_anti")
    by_rule = compress(others, frames, protect=False, vocab=vocab, label=label, size=size)
    short = F.array_contains("kept_reasons", ALL_KEPT)
    fallback = F.concat(F.array(F.lit(NO_MODEL)), "kept_reasons")
    rule = by_rule.summary.drop("protected").withColumns(
        {
            "method": F.when(short, F.lit("whole")).otherwise(F.lit("rule")),
            "kept_reasons": F.when(short, F.col("kept_reasons")).otherwise(fallback),
        }
    )
    return Compression(
        turns=model_turns.unionByName(by_rule.turns),
        summary=done.drop("compressed").unionByName(rule),
    )


def model_summary_input(
    turns: DataFrame, frames: DataFrame, vocab: Vocabulary = DEFAULT, per_turn: int = 300, limit: int = 1500
) -> DataFrame:
    """(conv_id, model_input): on-topic turns as "Role: text", in order, cut for the summary model.

    Each turn adds its role label at least, so a bounded number of first turns fills the limit.
    """
    heads = last_frames(frames).select("conv_id", F.col("turn").alias("current_turn"), "domain")
    topic = drop_distractors(valid_turns(turns), vocab).join(heads, "conv_id").filter(F.col("turn") <= F.col("current_turn"))
    who = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant"))
    lines = topic.select("conv_id", "turn", F.concat(who, F.lit(": "), F.substring("text", 1, per_turn)).alias("line"))
    first = top_per_group(lines, ["conv_id"], [F.col("turn").asc()], limit // len("User: ") + 1)
    joined = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("l"))
    text = F.substring(F.array_join(F.transform("l", lambda x: x["line"]), " "), 1, limit)
    return heads.join(joined, "conv_id", "left").select(
        "conv_id",
        F.concat(F.lit("summarize: DOMAIN:"), "domain", F.lit(" "), F.coalesce(text, F.lit(""))).alias("model_input"),
    )


def fallback_rate(summary: DataFrame) -> DataFrame:
    """Model requests, successes, fallbacks and their rate over a summary with a ``method`` column."""
    asked = F.col("method").isin("model", "rule")
    return summary.agg(
        F.count_if(asked).alias("requests"),
        F.count_if(F.col("method") == "model").alias("successes"),
        F.count_if(F.col("method") == "rule").alias("fallbacks"),
        F.coalesce(F.count_if(F.col("method") == "rule") / F.nullif(F.count_if(asked), F.lit(0)), F.lit(0.0)).alias(
            "fallback_rate"
        ),
    )
