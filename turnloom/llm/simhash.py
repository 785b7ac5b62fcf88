"""Near duplicates by SimHash: a byte-position inverted index proposes pairs, counts of shared positional bytes filter them.

Fingerprints that differ in at most 2 of 64 bits differ in at most 2 of 8 bytes, so 6 positional bytes agree at least. The
eight positions make four pairs; of these two agree whole. The index has a list for the bytes of each two of the four pairs
(six lists for a fingerprint), long enough a key that lists of unlike fingerprints are short. For each pair of a list the
positional bytes that agree are counted; pairs with fewer than six are dropped, the others verified bit by bit.

A list of more than LONG fingerprints is not paired. Fingerprints within 2 bits of each other have a common neighbour within
1 bit; each fingerprint is linked to the least one that shares such a neighbour. All these links are true links and they
connect the same fingerprints as all pairs would, with 33 rows for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import stored, text_bytes
from turnloom.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 2
LEAST_BYTES = 8 - MOST_BITS
LONG = 64  # fingerprints of a list from which neighbours take the place of pairs
BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)])

#: The positions (0 is the lowest byte) of the six index keys.
KEYS = [tuple(sorted(a + b)) for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]


def fingerprint(text: bytes) -> int:
    """Majority bits of the hashes of the word shingles, unsigned; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(columns[:, i], minlength=256) @ BITS for i in range(8)]
    bits = np.concatenate(counts) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (a signed long) of every row; a null text counts as empty."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), text_hash(F.col(text_col)))
    return rows.mapInArrow(fn, "doc_id long, text_hash long, fp long")


def _bytes_at(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _index(fps: DataFrame) -> DataFrame:
    """A row for each list that a fingerprint is on: which positions, and its bytes there."""
    keys = [F.struct(F.lit(i).alias("positions"), _bytes_at(F.col("fp"), p).alias("bytes")) for i, p in enumerate(KEYS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight bytes of a and b agree."""
    apart = a.bitwiseXOR(b)
    return sum((F.when(_bytes_at(apart, (p,)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _near(pairs: DataFrame) -> DataFrame:
    """Count filter, then the bits."""
    pairs = pairs.filter(shared_bytes(F.col("a"), F.col("b")) >= LEAST_BYTES)
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints fp that connect all fingerprints within MOST_BITS of each other."""
    index = stored(_index(fps), "simhash-index")
    sizes = index.groupBy("positions", "bytes").agg(F.count("*").alias("size")).filter("size > 1")
    lists = index.join(sizes, ["positions", "bytes"])
    short = lists.filter(F.col("size") <= LONG).groupBy("positions", "bytes").agg(F.collect_list("fp").alias("fps"))
    one = short.select("fps", F.explode("fps").alias("a"))
    pairs = one.select("a", F.explode("fps").alias("b")).filter("a < b")
    free = [[8 * p + bit for p in range(8) if p not in key for bit in range(8)] for key in KEYS]
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits)) for bits in free))
    around = lists.filter(F.col("size") > LONG).select("fp", "positions", F.explode(F.get(flips, F.col("positions"))).alias("flip"))
    around = around.select("positions", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("neighbour"))
    # a neighbour has at most 33 fingerprints around it, so a group here is small
    least = F.min("fp").over(Window.partitionBy("positions", "neighbour"))
    stars = around.select("fp", least.alias("least")).filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return _near(pairs.union(stars)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, root, fingerprint (16 lower-case hexadecimal digits) and component_id, the least id reachable.

    A row for each row of docs; root is the least fingerprint of the component.

    Texts without words have fingerprint zero and are linked like any other. Equal fingerprints are one node whatever their
    number. Null ids take part but never name a component, unless it has no other.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    reached = stored(components(links(nodes)), "simhash-components")
    of = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("least", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.join(ids, "root").select("fp", "root", "component_id")
    written = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "root", written.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates, with all their columns.

    Of each component the row with the least id stays (rows without id last, then the least hash of the text); of rows that
    repeat that id and text, one stays.
    """
    return keep_of(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of found (doc_id, text_hash, root), as `keep_first` says."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    first = found.groupBy("root").agg(first).select("first.doc_id", "first.text_hash").distinct()
    stay_id, stay_hash, own_hash = (f"{id_col}_{i}_{'_'.join(docs.columns)}" for i in range(3))
    stay = first.toDF(stay_id, stay_hash)
    rows = docs.withColumn(own_hash, text_hash(F.col(text_col)))
    kept = rows.join(stay, rows[id_col].cast("long").eqNullSafe(stay[stay_id]) & (rows[own_hash] == stay[stay_hash]), "left_semi")
    return kept.dropDuplicates([id_col, own_hash]).select(docs.columns)
