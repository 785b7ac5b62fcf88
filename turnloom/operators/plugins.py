"""Plugins as a table: the first plugin, in the order of the list, that has a keyword in a conversation so far.

Places of a text that begin like a keyword meet keywords of that length in a join, so a list of any length is neither read on
the driver nor made a part of the plan. Only its size in bytes and the number of its beginnings and lengths are read, which
decide what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.turns import valid_turns
from turnloom.plans.segments import SEGMENT, segment_of

GRAM = 4  # first characters that keywords and places in a text are joined on
PIECE = 256  # characters of a text whose places are listed in one row
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64  # of a keyword besides its characters
TURN = ["conv_id", "seg", "turn"]


def keyword_table(plugins: DataFrame) -> DataFrame:
    """(keyword, first): every keyword once, in lower case, with the least (ord, id) of the plugins that have it."""
    owner = F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"))
    rows = plugins.select(owner.alias("first"), F.explode("keywords").alias("k"))
    rows = rows.select("first", F.lower("k").alias("keyword")).filter(F.col("keyword").isNotNull())
    return rows.groupBy("keyword").agg(F.min("first").alias("first"))


def _places(rows: DataFrame, longest: int, lengths: list[int]) -> DataFrame:
    """(conv_id, seg, turn, here, gram): what stands at every place of a text, as long as the longest keyword."""
    text = f"transform(sequence(0, greatest(0, length(low) - 1), {PIECE}), i -> substring(low, i + 1, {PIECE + longest - 1}))"
    pieces = rows.select(*TURN, F.explode(F.expr(text)).alias("piece")).filter("piece <> ''")
    here = f"transform(sequence(1, least({PIECE}, length(piece))), i -> substring(piece, i, {longest}))"
    places = pieces.select(*TURN, F.explode(F.array_distinct(F.expr(here))).alias("here"))
    grams = F.array_distinct(F.array(*[F.substring("here", 1, n) for n in lengths]))
    return places.select(*TURN, "here", F.explode(grams).alias("gram"))


def turn_plugins(rows: DataFrame, plugins: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(conv_id, seg, turn, first) for turns with a keyword in their text, from rows(conv_id, seg, turn, low)."""
    words = keyword_table(plugins)
    n = F.length("keyword")
    facts = words.agg(
        F.sum(F.octet_length("keyword") + ROW_BYTES).alias("bytes"), F.max(n).alias("longest"),
        F.collect_set(F.least(n, F.lit(GRAM))).alias("lengths"), F.count_distinct(F.substring("keyword", 1, GRAM), n).alias("shapes"), F.min(F.when(n == 0, F.col("first"))).alias("always"),
    ).first()
    always = facts["always"] or (None, None)  # an empty keyword is in every text
    owner = F.struct(F.lit(always[0]).cast("long").alias("ord"), F.lit(always[1]).cast("string").alias("id"))
    everywhere = rows.filter(F.lit(facts["always"] is not None)).select(*TURN, owner.alias("first"))
    lengths = sorted(x for x in facts["lengths"] if x)
    if not lengths:
        return everywhere.distinct()
    worded = words.filter("keyword <> ''")
    shapes = worded.select(F.substring("keyword", 1, GRAM).alias("gram"), n.alias("n")).distinct()
    if facts["shapes"] * ROW_BYTES <= broadcast_bytes:  # then only places that begin like a keyword leave their task
        shapes = F.broadcast(shapes)
    if facts["bytes"] <= broadcast_bytes:
        worded = F.broadcast(worded)
    begun = _places(rows, facts["longest"], lengths).join(shapes, "gram")
    begun = begun.select(*TURN, F.substring(F.col("here"), F.lit(1), F.col("n")).alias("keyword")).distinct()
    met = begun.join(worded, "keyword")
    return met.select(*TURN, "first").unionByName(everywhere).groupBy(*TURN).agg(F.min("first").alias("first"))


def first_plugins(turns: DataFrame, plugins: DataFrame, size: int = SEGMENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(conv_id, turn, plugin): the first plugin with a keyword in the turn or an earlier one; turns without one have no row.

    plugins(ord, id, keywords, ...): rows without keywords never apply, of equal ord the smaller id is first. Rows of the same
    turn count as one.
    """
    rows = valid_turns(turns).select("conv_id", segment_of(F.col("turn"), size).alias("seg"), "turn", F.lower("text").alias("low"))
    hits = turn_plugins(rows, plugins, broadcast_bytes)
    placed = rows.select(*TURN).distinct().join(hits, TURN, "left")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("conv_id", "seg").agg(F.min("first").alias("first"))
    carried = carried.select("conv_id", "seg", F.min("first").over(before).alias("carried"))
    so_far = Window.partitionBy("conv_id", "seg").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("own", F.min("first").over(so_far)).join(carried, ["conv_id", "seg"])
    found = placed.select("conv_id", "turn", F.least("own", "carried")["id"].alias("plugin"))
    return found.filter(F.col("plugin").isNotNull())


def plugin_policies(plugins: DataFrame) -> DataFrame:
    """(domain, plugin_behavior, plugin_constraints): the first plugin of every id."""
    first = F.min(F.struct(F.col("ord").cast("long"), "behavior", "constraints"))
    return plugins.groupBy(F.col("id").alias("domain")).agg(first.alias("p")).select(
        "domain", F.col("p.behavior").alias("plugin_behavior"), F.col("p.constraints").alias("plugin_constraints")
    )
