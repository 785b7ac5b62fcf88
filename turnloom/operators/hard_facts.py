"""Concrete values of a whole conversation: dates, names, units, phones, ids, prices.

The patterns run on the turns joined by blanks, so a value may cross a turn boundary. Turns are
therefore grouped into runs: a boundary is inside a run only where the left text can begin and the
right text can continue such a value. Nearly all runs are single turns and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.facts import drop_subsumed
from turnloom.functions.regex import SPACE, SPACES
from turnloom.functions.sqltext import NO_STRINGS, find_all, q, strings, ws_trim
from turnloom.functions.text import distinct_by_lower
from turnloom.functions.vocab import HARD_FACT_PATTERNS
from turnloom.plans.segments import top_per_group

FIRST_FACTS = 20

_MONTH = (
    r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)"
)
_OPEN_END = rf"(?:(?<!\w)of|(?<!\w){_MONTH}|\d(?:st|nd|rd|th|ST|ND|RD|TH)?,?)\z"
_END = 12  # characters that _OPEN_END looks at, and more
_MARKS, _LOWER, _DIGITS = "().-", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LAST = 64  # characters of a text that are looked at first
_OPEN_HEAD = (
    rf"\A{SPACE}*(?:[A-Z][a-z]|\d|[-().%]|\z|(?i:of|ms|gb|mb|tb|kb|rpm|rps|usd|dollars?|kg|km|mi|mph|k|m|b|million"
    r"|thousand|was|is|are|were|did|has|have|began|started|founded|built|hired|located)(?!\w))"
)


_NAMES = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def _without_recursion(pattern: str) -> str:
    """A pattern that captures names before a verb, with the same captures on any length of text.

    Java calls itself for each round of a loop that may give rounds back; a few thousand names in a row end the stack, and that
    error ends the executor. No round can be given back, as no verb begins with a capital, so the loop need not remember them.
    Names without a verb are passed over whole, with an empty capture, as none of them can begin a match.
    """
    if _NAMES not in pattern:
        return pattern
    start, end = pattern.split(f"({_NAMES})")
    return f"{start}(?:({_NAMES}+){end}|{_NAMES}+)"


def _open_tail(text: Column) -> Column:
    """Whether a value may go on behind the text: it is blank or ends with a name, a word of a date, or digits, marks and blanks.

    Only the end is looked at, as far back as it takes; a pattern would be tried at every place, with a call for each character.
    """

    def of(end: Column) -> Column:
        bare = F.rtrim(end, F.lit(SPACES))
        name = F.rtrim(bare, F.lit(_LOWER))
        return (
            (bare == "")
            | ((name != bare) & F.right(name, F.lit(1)).between("A", "Z"))
            | F.right(F.rtrim(end, F.lit(SPACES + _MARKS)), F.lit(1)).between("0", "9")
            | F.right(bare, F.lit(_END)).rlike(_OPEN_END)
        )

    last = F.right(text, F.lit(_LAST))
    enough = F.length(F.rtrim(last, F.lit(SPACES + _MARKS + _LOWER + _DIGITS))) >= _END
    return F.transform(F.array(F.when(enough, last).otherwise(text)), of)[0]


def fact_structs(text: str, domain: str) -> str:
    """All matches as (family, idx, value), in collection order, as SQL text."""
    parts = []
    for family, (pattern, only, group) in enumerate(HARD_FACT_PATTERNS):
        found = find_all(text, _without_recursion(pattern), group)
        if only is not None:
            found = f"IF({domain} = {q(only)}, {found}, {NO_STRINGS})"
        entry = f"struct({family} AS family, i AS idx, {ws_trim('v')} AS value)"
        parts.append(f"transform({found}, (v, i) -> {entry})")
    return f"filter({strings(parts)}, s -> length(s.value) >= 3)"


def _runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into turns that stand alone and turns that belong to a run of several."""
    flagged = rows.withColumns(
        {"open_tail": _open_tail(F.col("text")), "open_head": F.col("text").rlike(_OPEN_HEAD)}
    )
    w = Window.partitionBy("conv_id", "seg").orderBy("pos")
    flagged = flagged.withColumn("joins_prev", F.lag("open_tail").over(w) & F.col("open_head"))

    # what neighbouring segments need from each other: one row per segment
    inner_start = F.when(F.col("joins_prev") == F.lit(False), F.col("pos"))
    edges = flagged.groupBy("conv_id", "seg").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("open_head", "pos").alias("first_head"),
        F.max_by("open_tail", "pos").alias("last_tail"),
        F.max(inner_start).alias("last_start"),
    )
    by_seg = Window.partitionBy("conv_id").orderBy("seg")
    edges = edges.withColumn(
        "first_joins", F.coalesce(F.lag("last_tail").over(by_seg), F.lit(False)) & F.col("first_head")
    )
    seg_start = F.greatest(F.col("last_start"), F.when(~F.col("first_joins"), F.col("first_pos")))
    edges = edges.withColumn("seg_start", seg_start)
    edges = edges.select(
        "conv_id",
        "seg",
        "first_joins",
        F.max("seg_start").over(by_seg.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_start"),
        F.coalesce(F.lead("first_joins").over(by_seg), F.lit(False)).alias("next_joins"),
    )

    placed = flagged.join(edges, ["conv_id", "seg"])
    joins_prev = F.coalesce("joins_prev", "first_joins")
    next_open = F.lead("open_head").over(w)
    placed = placed.withColumn("joins", joins_prev).withColumn(
        "continues", F.coalesce(F.col("open_tail") & next_open, F.col("next_joins"))
    )
    start = F.max(F.when(~F.col("joins"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("run", F.coalesce(start, F.col("carry_start"))).select(
        "conv_id", "domain", "pos", "run", "text", "joins", "continues"
    )
    alone = ~F.col("joins") & ~F.col("continues")
    return placed.filter(alone), placed.filter(~alone)


def hard_facts(rows: DataFrame, limit: int = 12) -> DataFrame:
    """(conv_id, hard_facts) from rows (conv_id, seg, pos, text, domain); conversations without facts are absent."""
    single, several = _runs(rows)
    joined = several.groupBy("conv_id", "run").agg(
        F.first("domain").alias("domain"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " "
        ).alias("text"),
    )
    texts = single.select("conv_id", "run", "domain", "text").unionByName(
        joined.select("conv_id", "run", "domain", "text")
    )
    found = texts.select(
        "conv_id", "run", F.explode_outer(F.expr(fact_structs("text", "domain"))).alias("f")
    ).filter(F.col("f").isNotNull()).select("conv_id", F.struct("f.family", "run", "f.idx").alias("place"), F.col("f.value").alias("value"))
    first = found.groupBy("conv_id", F.lower("value").alias("key")).agg(
        F.min("place").alias("place"), F.min_by("value", "place").alias("value")
    )
    top = top_per_group(first, ["conv_id"], [F.col("place").asc()], FIRST_FACTS)
    listed = top.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("l"))
    return listed.select("conv_id", F.expr(drop_subsumed("transform(l, s -> s.value)", limit)).alias("hard_facts"))


def hard_facts_of(text: str, domain: str, limit: int = 12) -> Column:
    """The same for one bounded text."""
    values = f"transform({fact_structs(text, domain)}, s -> s.value)"
    return F.expr(drop_subsumed(f"slice({distinct_by_lower(values)}, 1, {FIRST_FACTS})", limit))
