"""Nearest neighbours by cosine through a forest of hash prefixes.

Each tree gives a vector a long hash string: BITS sides of hyperplanes. A tree is kept as sorted arrays: blocks of rows in the
order of the strings, range-sharded and cut by size, so that no prefix, however common, has to fit in a task. A query
descends to its longest prefix by binary search, and ascends in all trees at once, one bit at a time, until the rows that share
that many bits with it in some tree are enough; all of those are scored exactly.

How many are enough is fitted: for SAMPLE of the queries the true neighbours are searched among all rows, and the least number
is taken that finds TARGET of them. Rows with equal vectors are one entry with the ids that can count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import shuffle_partitions, stored
from turnloom.llm.vectors import binary, dimensions, finite, first_of, lists, matrix

TREES = 12
BITS = 62
SEED = 11
SAMPLE = 256  # queries whose true neighbours are searched
LEARN = 4096  # rows whose middle the hyperplanes go through
TARGET = 0.96
MOST = 5
BLOCK = 8192
QUERIES = 4096  # at once


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector: finite vectors that are not zero, one for each vec_id (the least)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def even(table: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two so that squares neither overflow nor vanish; a cosine stays the same to the last bit."""
    return np.ldexp(table, -np.frexp(np.abs(table).max(axis=1, initial=0))[1][:, None])


def units(table: np.ndarray) -> np.ndarray:
    table = even(table)
    return table / np.sqrt((table**2).sum(axis=1))[:, None]


class Planes:
    """The hyperplanes of all trees, through the middle of a bounded sample."""

    def __init__(self, sample: np.ndarray, width: int):
        self.normals = np.random.default_rng(SEED).normal(size=(width, TREES * BITS))
        self.at = np.median(units(sample) @ self.normals, axis=0) if len(sample) else np.zeros(TREES * BITS)

    def codes(self, table: np.ndarray) -> np.ndarray:
        """A hash string of BITS bits for each row and tree."""
        sides = (units(table) @ self.normals > self.at).reshape(len(table), TREES, BITS)
        return sides @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each by the same sums wherever it is computed."""
    a, b = even(a), even(b)
    return (a * b).sum(axis=1) / (np.sqrt((a**2).sum(axis=1)) * np.sqrt((b**2).sum(axis=1)))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the nearest rows of the table for every query, ties to smaller ids."""
    scores = units(queries) @ units(table).T
    if scores.shape[1] > most:
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    else:
        least = np.full(len(scores), -np.inf)
    q, r = np.nonzero(scores >= least[:, None] - 1e-9)  # whatever rounding may have put behind
    exact = cosine(queries[q], table[r])
    kept = first_of(q, exact, ids[r], most)
    return query_ids[q[kept]], ids[r[kept]], exact[kept]


_FOUND = ("query", "entry", "score")
FOUND = "query long, entry long, score double"


def _found(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(_FOUND))


def _entries(rows: DataFrame) -> DataFrame:
    """entry (the least id), ids (the MOST + 1 least) and vector of every distinct vector."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= MOST + 1)
    made = first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return made.select(F.col("ids")[0].alias("entry"), "ids", "vector")


def _coded(entries: DataFrame, planes: Planes, width: int) -> DataFrame:
    """entry, vector and codes, one for each tree."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                codes = planes.codes(matrix(part.column(1), width))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(codes)], names=["entry", "vector", "codes"])

    return entries.select("entry", "vector").mapInArrow(fn, "entry long, vector array<double>, codes array<long>")


def _sorted_arrays(coded: DataFrame, total: int, width: int, block_rows: int) -> DataFrame:
    """The trees: tree, block, low, high, codes, entries and vectors of runs of at most block_rows rows."""
    single = coded.select("entry", "vector", F.posexplode("codes").alias("tree", "code"))
    order = ["tree", "code", "entry"]
    # the number of blocks follows that of the rows, not that of the tasks, as queries visit blocks
    blocks = -(-TREES * max(1, total) // block_rows)
    shards = min(blocks, max(TREES * shuffle_partitions(coded.sparkSession), blocks // 16))
    sharded = single.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("tree").to_numpy()
            cuts = np.flatnonzero(np.diff(trees)) + 1
            starts = np.unique(np.concatenate([cuts, np.arange(0, len(trees), block_rows)]))
            # a cut of a tree inside a run gives two shorter runs
            for a, b in zip(starts, np.append(starts[1:], len(trees)), strict=True):
                part = batch.slice(a, b - a)
                codes, entries = (part.column(c).to_numpy() for c in ("code", "entry"))
                table = matrix(part.column("vector"), width)
                small = table.astype(np.float32)
                table = small if (small == table).all() else table
                packed = [int(trees[a]), int(codes[0]), int(codes[-1]), binary(codes), binary(entries), table.dtype.char.encode() + binary(table)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, kinds, strict=True)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["tree", "low", "high", "codes", "entries", "vectors"]
    made = sharded.mapInArrow(fn, "tree int, low long, high long, codes binary, entries binary, vectors binary")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), "forest")


def _prefix(code: str, level: str) -> Column:
    return F.expr(f"shiftright({code}, {BITS} - {level})")


def _directory(forest: DataFrame, levels: int) -> DataFrame:
    """tree, level, prefix, block: the blocks that hold rows of a prefix, for prefixes of up to levels bits."""
    rows = forest.select("tree", "block", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    spans = F.sequence(_prefix("low", "level"), _prefix("high", "level"))
    return rows.select("tree", "block", "level", F.explode(spans).alias("prefix"))


def _counts(queries: DataFrame, coded: DataFrame, forest: DataFrame, directory: DataFrame, levels: int) -> DataFrame:
    """query, level, n: rows, counted once a tree, that share level bits with a query in a tree; n > 1 only.

    Up to `levels` bits rows are counted by prefix, beyond that by binary search in the blocks that a query's prefix is in.
    """
    single = queries.select("query", F.posexplode("codes").alias("tree", "code"))
    own = coded.select(F.posexplode("codes").alias("tree", "code"))
    by_prefix = own.groupBy("tree", _prefix("code", str(levels)).alias("prefix")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = by_prefix.select("tree", "prefix", "n", level).groupBy("tree", "level", F.expr(f"shiftright(prefix, {levels} - level)").alias("prefix"))
    up = stored(up.agg(F.sum("n").alias("n")), "forest-prefixes")
    asked = single.select("query", "tree", "code", level).withColumn("prefix", _prefix("code", "level"))
    high = asked.join(up, ["tree", "level", "prefix"]).select("query", "level", "n")

    at = single.withColumn("level", F.lit(levels)).withColumn("prefix", _prefix("code", "level")).join(directory, ["tree", "level", "prefix"])
    sought = at.groupBy("block", F.pmod(F.xxhash64("query"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("query", "code")).alias("asked"))
    shifts = BITS - np.arange(levels + 1, BITS + 1, dtype=np.int64)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int64)
                asked = batch.column("asked")[i].values
                ids, own = (asked.field(c).to_numpy() for c in ("query", "code"))
                first = own[:, None] >> shifts << shifts
                n = np.searchsorted(codes, first + (np.int64(1) << shifts)) - np.searchsorted(codes, first)
                q, at = np.nonzero(n)
                columns = [pa.array(ids[q]), pa.array((at + levels + 1).astype(np.int32)), pa.array(n[q, at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "level", "n"])

    deep = sought.join(forest.select("block", "codes"), "block").mapInArrow(fn, "query long, level int, n long")
    return high.union(deep).groupBy("query", "level").agg(F.sum("n").alias("n")).filter("n > 1")


def _fitted(entries: DataFrame, queries: DataFrame, counts: DataFrame, planes: Planes, width: int) -> int:
    """The least number of rows at which a query may stop ascending, so that TARGET of the true neighbours are found."""
    picked = queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).select("query", "vector").toPandas()
    if not len(picked):
        return 0
    ids = picked["query"].to_numpy()
    asked = np.zeros((len(ids), width))
    for i, v in enumerate(picked["vector"]):
        asked[i, : len(v)] = v

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield _found(best(ids, asked, part.column(0).to_numpy(), matrix(part.column(1), width), MOST + 1))

    near = _top(entries.select("entry", "vector").mapInArrow(fn, FOUND)).filter("query <> entry")
    true = near.join(entries.select("entry", "vector"), "entry").select("query", "vector").toPandas()
    if not len(true):
        return 0
    of = true["query"].to_numpy()
    other = np.zeros((len(of), width))
    for i, v in enumerate(true["vector"]):
        other[i, : len(v)] = v
    nth = {q: i for i, q in enumerate(ids.tolist())}
    at = np.array([nth[q] for q in of.tolist()])
    differ = planes.codes(asked)[at] ^ planes.codes(other)
    shared = (BITS - np.ceil(np.log2(differ.astype(np.float64) + 1))).max(axis=1)  # bits of the longest common prefix
    table = np.zeros((len(ids), BITS + 1), np.int64)
    for r in counts.filter(F.col("query").isin([int(i) for i in ids])).collect():
        table[nth[r["query"]], r["level"]] = r["n"]
    for enough in 2.0 ** np.arange(3, 64, 0.25):
        stop = BITS - (table[:, ::-1] >= enough).argmax(axis=1)
        stop[(table >= enough).sum(axis=1) == 0] = 0
        if (shared >= stop[at]).mean() >= TARGET:
            return int(enough)
    return 1 << 62


def _top(found: DataFrame) -> DataFrame:
    """The MOST + 1 nearest entries of each query; trees that found the same entry count once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    return found.dropDuplicates(["query", "entry"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST + 1)


def _search(queries: DataFrame, forest: DataFrame, directory: DataFrame, levels: int, width: int) -> DataFrame:
    """query, entry, score of the rows that share a query's prefix of stop bits in some tree: the nearest of each block."""
    single = queries.select("query", "stop", F.posexplode("codes").alias("tree", "code")).withColumn("level", F.least("stop", F.lit(levels)))
    pairs = single.withColumn("prefix", _prefix("code", "level")).join(directory, ["tree", "level", "prefix"]).select("query", "stop", "code", "block")
    pairs = stored(pairs, "forest-visits")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    asked = pairs.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(queries.select("query", "vector"), "query")
    held = forest.select("block", "codes", "entries", "vectors").join(parts, "block")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            row = {c: right.column(c)[0].as_py() for c in ("codes", "entries", "vectors")}
            codes, entries = (np.frombuffer(row[c], np.int64) for c in ("codes", "entries"))
            table = np.frombuffer(row["vectors"], row["vectors"][:1].decode(), offset=1).reshape(len(codes), -1).astype(np.float64)
            ids, own, stop = (left.column(c).to_numpy() for c in ("query", "code", "stop"))
            vectors = matrix(left.column("vector").combine_chunks(), width)
            shifts = BITS - stop.astype(np.int64)
            first = own >> shifts << shifts
            runs = np.stack([np.searchsorted(codes, first), np.searchsorted(codes, first + (np.int64(1) << shifts))], axis=1)
            for run in np.unique(runs, axis=0):
                at = np.flatnonzero((runs == run).all(axis=1))
                for a in range(0, len(at) if run[0] < run[1] else 0, 512):
                    some = at[a : a + 512]
                    out.append(_found(best(ids[some], vectors[some], entries[run[0] : run[1]], table[run[0] : run[1]], MOST + 1)))
        empty = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, empty)

    return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(fn, FOUND)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the MOST nearest rows found for each row that is_query tells by vec_id.

    Null, zero and non-finite vectors and null ids take no part; rows that repeat a vec_id count once (the least vector). Vectors
    of unequal length are compared as if filled up with zeros. Rows of equal vectors are tied and come by id. Without queries
    there are no rows; a query without other rows has none.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "forest-vectors")
    entries = stored(_entries(rows), "forest-entries")
    total, width = entries.count(), max(1, dimensions(entries))
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(LEARN).select("vector").toPandas()
    learned = np.zeros((len(sample), width))
    for i, v in enumerate(sample["vector"]):
        learned[i, : len(v)] = v
    planes = Planes(learned, width)
    coded = stored(_coded(entries, planes, width), "forest-codes")
    forest = _sorted_arrays(coded, total, width, block_rows)
    levels = max(0, (max(1, total) // block_rows).bit_length())
    directory = stored(_directory(forest, levels), "forest-directory")
    ids = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    ids = stored(ids.join(entries.select("vector", F.col("entry").alias("query")), "vector").select("query_id", "query"), "forest-queries")
    queries = coded.join(ids.select(F.col("query").alias("entry")).distinct(), "entry").withColumnRenamed("entry", "query")
    queries = stored(queries, "forest-asked")
    counts = stored(_counts(queries, coded, forest, directory, levels), "forest-counts")
    enough = _fitted(entries, queries, counts, planes, width)
    stops = counts.filter(F.col("n") >= enough).groupBy("query").agg(F.max("level").alias("stop"))
    queries = queries.join(stops, "query", "left").withColumn("stop", F.coalesce("stop", F.lit(0)))
    found = stored(_top(_search(queries, forest, directory, levels, width)), "forest-found")
    named = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = ids.join(named, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= MOST).select("query_id", "rank", "vec_id", "score")
