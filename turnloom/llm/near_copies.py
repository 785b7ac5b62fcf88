"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and what they connect.

The method is that of `simhash`, with wider fingerprints: 256 majority bits over the hashes of a set, 32 positional bytes. An
inverted index has a list for the bytes at each of 64 triples of positions; the members of a list are paired with the one that is
on the longest lists. Pairs that agree in fewer than LEAST_BYTES positional bytes are dropped, the sets of the others compared.

Fingerprints of similar sets are close only as a rule, so pairs that are not connected by then get an exact second look. The
shingles of a set are ordered by one order for all texts. Two sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of each, so a list for every shingle of these beginnings holds every pair; the sizes and the number of
lists that a pair is on bound what it can share, and the sets themselves decide. No pair is lost. The order puts shingles last
whose hash falls where many of an eighth of all texts have one, which keeps the lists short; it decides nothing else.

No text leaves the JVM: shingles are SQL functions, the majority bits an Arrow function over their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import measured_broadcasts, stored
from turnloom.llm.components import components
from turnloom.llm.simhash import keep_of, shared_bytes, text_hash

SHINGLE = 5
LEAST = (4, 5)  # similarity as a fraction
PLACES = 1 << 15  # that shingles are counted by
SHARE = 8  # one text of so many is counted
WORDS = 4  # of 64 bits in a fingerprint
LEAST_BYTES = 6  # of 32 that sets proposed agree in; of sets as similar as 0.8 nearly nine agree
RUN = 1 << 14  # shingles whose bits are counted at once
BATCH = 1000  # sets that a Python worker gets at once
HELD = 1 << 20  # rows of names of sets that are broadcast at most
#: The positions (0 is the lowest byte of the first word) of the index keys; no two keys share two positions.
KEYS = [tuple((p + step) % (8 * WORDS) for step in steps) for steps in [(0, 1, 3), (0, 4, 9)] for p in range(8 * WORDS)]
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def shingles(text: Column) -> Column:
    """Hashes of the distinct shingles, in order; a text of fewer words is one shingle, a text without words has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+")

    def hashed(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
        return F.when(F.size(words) > 0, F.sort_array(F.array_distinct(found))).otherwise(F.array().cast("array<long>"))

    return _let(F.filter(parts, lambda w: w != ""), hashed)


def _words_of(hashes: np.ndarray) -> np.ndarray:
    """A row of WORDS words for each hash: itself and mixtures of it (the finalizer of splitmix64)."""
    mixed = hashes[:, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    mixed[:, 0] = hashes
    return mixed


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of each of the sets that lie one after the other in hashes, as rows of WORDS words; 0 for an empty set."""
    counts = np.zeros((len(sizes), 64 * WORDS), np.int32)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), RUN):
        part = of[at : at + RUN]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        octets = _words_of(hashes[at : at + RUN]).astype("<u8").view(np.uint8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        counts[part[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")


def fingerprint(sets: pa.Array) -> pa.Array:
    """The words of the fingerprint of each set of shingle hashes."""
    hashes = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = majority(hashes, sizes).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, WORDS), pa.int32()), pa.array(words))


def _place(shingle: Column) -> Column:
    return F.pmod(shingle, F.lit(PLACES)).cast("int")


def _common(rows: DataFrame) -> bytes:
    """For each place how common the shingles there are, as a byte that only orders."""
    some = rows.filter(F.pmod("text_hash", F.lit(SHARE)) == 0).select(F.explode(shingles(F.col("text"))).alias("shingle"))
    counted = some.groupBy(_place(F.col("shingle")).alias("place")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(PLACES, np.int64)
    counts[counted["place"].to_numpy(int)] = counted["n"].to_numpy(np.int64)
    # half of the places are about as common as any; steps of a quarter apart beyond that
    above = counts / max(1.0, float(np.median(counts)))
    return np.clip(np.ceil(4 * np.log2(np.maximum(above, 1))), 0, 255).astype(np.uint8).tobytes()


def _beginning(found: Column, common: bytes) -> Column:
    """The first shingles of a set, in the common order, one of which every similar set shares."""
    part, whole = LEAST
    table = F.lit(common)
    ranked = F.sort_array(F.transform(found, lambda s: F.struct(F.substring(table, _place(s) + 1, F.lit(1)).alias("rank"), s.alias("shingle"))))
    most = F.size(found) - F.ceil(F.size(found) * part / whole).cast("int") + 1
    return F.transform(F.slice(ranked, F.lit(1), most), lambda x: x["shingle"])


def _beginnings(rows: DataFrame, common: bytes) -> DataFrame:
    """doc_id, text_hash, node (a name for the set, the same for equal sets), n (its size), its fingerprint and first, its beginning."""
    made = rows.withColumn("set", _let(shingles(F.col("text")), lambda s: F.struct(F.xxhash64(s).alias("node"), F.size(s).alias("n"), _beginning(s, common).alias("first"), s.alias("all"))))
    return made.select("doc_id", "text_hash", "set.node", "set.n", F.arrow_udf(fingerprint, "array<long>")("set.all").alias("print"), "set.first")


def _stored_beginnings(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(BATCH))
    try:
        return stored(_beginnings(rows, _common(rows)), "near-beginnings")
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _index(nodes: DataFrame) -> DataFrame:
    """A row for each list that a fingerprint is on; key tells which positions and the bytes there."""

    def byte(p: int) -> Column:
        return F.shiftrightunsigned(F.get("print", F.lit(p // 8)), 8 * (p % 8)).bitwiseAND(F.lit(0xFF).cast("long"))

    def key(i: int, positions: tuple[int, ...]) -> Column:
        return sum((byte(p) * F.lit(1 << (8 * j)).cast("long") for j, p in enumerate(positions)), F.lit(i << 24).cast("long"))

    return nodes.select("node", F.explode(F.array(*(key(i, p) for i, p in enumerate(KEYS)))).alias("key"))


def alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the index of the fingerprints proposes and the count of shared positional bytes leaves.

    nodes has a row (node, n, print) for each set. In a list every member is paired with one, so work grows with the index.
    """
    index = _index(nodes)
    sizes = index.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    lists = stored(index.join(sizes, "key"), "near-byte-lists")
    longest = lists.groupBy("node").agg(F.sum("size").alias("total"))
    hubs = lists.join(longest, "node").groupBy("key").agg(F.max(F.struct("total", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    met = lists.join(hubs, "key").filter("node <> hub")
    pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = pairs.join(nodes.toDF("a", "n_a", "print_a"), "a").join(nodes.toDF("b", "n_b", "print_b"), "b")
    shared = sum((shared_bytes(F.get("print_a", F.lit(i)), F.get("print_b", F.lit(i))) for i in range(WORDS)), F.lit(0))
    part, whole = LEAST
    return pairs.filter((shared >= LEAST_BYTES) & (F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part)).select("a", "b")


def _held(table: DataFrame) -> DataFrame:
    """A stored table of names for a join with larger rows: broadcast by its count, as an estimate may be far too low."""
    return F.broadcast(table) if table.count() <= HELD else table.hint("merge")


def _sets(rows: DataFrame, begun: DataFrame, needed: DataFrame) -> DataFrame:
    """node and its whole set for the nodes needed, made again from one text of each."""
    from_text = begun.join(needed, "node").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("of"))
    from_text = stored(from_text.select("node", "of.text_hash", F.col("of.doc_id").alias("of_id")), "near-needed")
    held = _held(from_text)
    picked = rows.join(held, (rows["text_hash"] == held["text_hash"]) & rows["doc_id"].eqNullSafe(held["of_id"]))
    return picked.select("node", shingles(F.col("text")).alias("shingles")).dropDuplicates(["node"])


def _enough(shared: Column, n_a: Column, n_b: Column) -> Column:
    part, whole = LEAST
    return shared * (part + whole) >= (n_a + n_b) * part


def _pairs(matched: DataFrame) -> DataFrame:
    """Distinct (a, b) of rows with the members x and y of a list that may be similar enough.

    What two sets share outside both beginnings is behind one of the beginnings, so it is less than 0.8 of the larger set.
    """
    part, whole = LEAST
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    sized = matched.filter(small * whole >= large * part)
    ends = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    counted = sized.select(*ends, small.alias("small"), large.alias("large")).groupBy("a", "b", "small", "large").agg(F.count("*").alias("shared"))
    behind = F.floor((F.col("large") * part + whole - 1) / whole) - 1
    return counted.filter(_enough(F.col("shared") + behind, F.col("small"), F.col("large"))).select("a", "b")


def _near(pairs: DataFrame, rows: DataFrame, begun: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = stored(pairs, "near-pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_sets(rows, begun, needed), "near-sets")
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return stored(both.filter(_enough(shared, F.size("of_a"), F.size("of_b"))).select("a", "b"), "near-links")


def _connected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The beginnings of rows (doc_id, text, text_hash), and (node, least) of the nodes that near copies connect."""
    begun = _stored_beginnings(rows)
    nodes = stored(begun.select("node", "n", "print").dropDuplicates(["node"]), "near-prints")
    links = _near(alike(nodes), rows, begun)
    reached = stored(components(links), "near-components")
    of = _held(reached).withColumnRenamed("least", "root")
    member = F.struct("node", "n", F.coalesce("root", "node").alias("root")).alias("x")
    index = begun.join(of, "node", "left").select(member, F.explode("first").alias("shingle"))
    apart = index.groupBy("shingle").agg(F.min("x.root").alias("low"), F.max("x.root").alias("high")).filter("low < high").select("shingle")
    lists = stored(index.join(apart, "shingle").distinct(), "near-lists")
    left = lists.join(lists.withColumnRenamed("x", "y"), "shingle").filter((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    more = _near(_pairs(left), rows, begun)
    if not more.isEmpty():
        reached = stored(components(links.union(more)), "near-components")
    return begun, reached


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and root, a row for each row of docs; rows have the same root if near copies connect them.

    A null text counts as empty; texts without words are copies of each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    with measured_broadcasts(docs.sparkSession):
        begun, reached = _connected(rows)
    named = begun.join(_held(reached), "node", "left")
    return named.select("doc_id", "text_hash", F.coalesce("least", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies, with all their columns; the rule of `simhash.keep_first` says which stay."""
    return keep_of(docs, near_copies(docs, id_col, text_col), id_col, text_col)
