"""Hard negatives by segment summaries.

Vectors are packed into blocks. A block stores, for each vector and each of SEGMENTS segments of its components, the mean
(times the root of the length) and the deviation (length of what is left without the mean). The product of two segments is the product
of their means plus or minus that of their deviations, so sums over segments bound a score from both sides. Bounds are taken
over few wide segments first and over finer ones for what is left; only pairs that no bound rules out are scored.

Anchors are packed into blocks as well; every block of rows meets every block of anchors, the anchors being the stated query
set. The best rows that a task has seen for an anchor raise the bound that later blocks have to reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import shuffle_partitions, stored
from turnloom.llm.vectors import binary, dimensions, finite, first_of, matrix

SEGMENTS = (2, 4, 16)  # each a multiple of the one before
ROWS = 2048  # of a block
ANCHORS = 512  # of a block, about
SCALE = 256
EDGE = 1e150  # components beyond it are cut off
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # hundredths of the positive's score between which a negative's lies

PACKED = "ids binary, labels binary, whole binary, means binary, deviations binary"
_BYTES = ("ids", "labels", "whole", "means", "deviations")


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label, vector; one row for each vec_id (least label, then least vector)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def whole_numbers(table: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * table), -EDGE, EDGE)


def _small(whole: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes as hold them exactly."""
    most = np.abs(whole).max(initial=0)
    return whole.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def summaries(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean times the root of the length, and deviation, of each of the finest segments."""
    parts = whole.reshape(len(whole), SEGMENTS[-1], -1)
    mean = parts.mean(axis=2)
    deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return mean * math.sqrt(parts.shape[2]), deviation


def coarser(means: np.ndarray, deviations: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of wider segments from those of finer ones."""
    m = means.reshape(len(means), segments, -1)
    d = deviations.reshape(len(means), segments, -1)
    mean = m.sum(axis=2) / math.sqrt(m.shape[2])
    spread = (d**2).sum(axis=2) + ((m - mean[:, :, None] / math.sqrt(m.shape[2])) ** 2).sum(axis=2)
    return mean, np.sqrt(spread)


def _pack(ids: np.ndarray, labels: np.ndarray, table: np.ndarray) -> tuple[bytes, ...]:
    small = _small(whole_numbers(table))
    means, deviations = summaries(small.astype(np.float64))
    return binary(ids), binary(labels), small.dtype.char.encode() + binary(small), binary(means), binary(deviations)


class Block:
    """A packed block: ids, labels, whole vectors and their summaries by level."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        n = len(self.ids)
        self.whole = np.frombuffer(row["whole"], row["whole"][:1].decode(), offset=1).reshape(n, -1).astype(np.float64)
        finest = [np.frombuffer(row[c], np.float64).reshape(n, -1) for c in ("means", "deviations")]
        self.levels = [coarser(*finest, s) for s in SEGMENTS]
        self.norms = np.sqrt((self.whole**2).sum(axis=1))


def _refined(anchors: Block, rows: Block, open_pairs: np.ndarray, least, most: np.ndarray | None) -> np.ndarray:
    """open_pairs without those that the bounds rule out. least(lower, open) gives what an anchor's scores must reach."""
    margin = 1e-9 * anchors.norms[:, None]  # for rounding
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True):
        at = np.flatnonzero(open_pairs.any(axis=0))
        if not len(at):
            break
        part = open_pairs[:, at]
        middle, reach = am @ rm[at].T, ad @ rd[at].T
        reach += margin * rows.norms[at] + 1e-6
        part &= middle + reach >= least(middle - reach, part)[:, None]
        if most is not None:
            part &= middle - reach <= most[:, None]
        open_pairs[:, at] = part
    return open_pairs


def _kth_best(table: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    if table.shape[1] < k:
        return np.full(len(table), -np.inf)
    return np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k]


def _scores(anchors: Block, rows: Block, open_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns with open pairs and the scores there, minus infinity for closed pairs."""
    at = np.flatnonzero(open_pairs.any(axis=0))
    scores = anchors.whole @ rows.whole[at].T
    scores[~open_pairs[:, at]] = -np.inf
    return at, scores


class Best:
    """The first rows found so far for each of some groups."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        kept = first_of(group, score, ids, self.most)
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.most)
        self.least[last] = self.score[np.searchsorted(self.group, last, "right") - 1]


def add_positives(best: Best, anchors: Block, rows: Block) -> None:
    open_pairs = anchors.labels[:, None] == rows.labels
    open_pairs &= anchors.ids[:, None] != rows.ids
    k = best.most

    def least(lower: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.maximum(best.least, _kth_best(np.where(part, lower, -np.inf), k))

    at, scores = _scores(anchors, rows, _refined(anchors, rows, open_pairs, least, None))
    if len(at):
        floor = np.maximum(best.least, _kth_best(scores, k))
        a, j = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        best.add(a, scores[a, j], rows.ids[at[j]])


def add_negatives(best: Best, anchors: Block, rows: Block, positive: np.ndarray) -> None:
    """positive: for each anchor the scores of its positives, filled up with NaN. best has a group for each of them."""
    count = positive.shape[1]
    usable_score = positive >= 0  # a negative score has no range
    floors = np.where(usable_score, np.ceil(LOW * positive / 100), np.inf)
    ceilings = np.where(usable_score, np.floor(HIGH * positive / 100), -np.inf)
    floors = np.maximum(floors, best.least.reshape(-1, count))
    lowest, highest = floors.min(axis=1), ceilings.max(axis=1)
    open_pairs = (anchors.labels[:, None] != rows.labels) & np.isfinite(lowest)[:, None]
    at, scores = _scores(anchors, rows, _refined(anchors, rows, open_pairs, lambda _, __: lowest, highest))
    for k in range(count if len(at) else 0):
        fits = (scores >= floors[:, k : k + 1]) & (scores <= ceilings[:, k : k + 1])
        fits &= (100 * scores >= LOW * positive[:, k : k + 1]) & (100 * scores <= HIGH * positive[:, k : k + 1])
        own = np.where(fits, scores, -np.inf)
        fits &= own >= _kth_best(own, best.most)[:, None]
        a, j = np.nonzero(fits)
        best.add(a * count + k, scores[a, j], rows.ids[at[j]])


def _row_blocks(rows: DataFrame, width: int, salts: int) -> DataFrame:
    """Packed blocks of rows, dealt to salts."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = _pack(*(part.column(c).to_numpy() for c in ("vec_id", "label")), matrix(part.column("vector"), width))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in packed], names=list(_BYTES))

    packed = rows.mapInArrow(fn, PACKED)
    return stored(packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")), "negative-rows")


def _anchor_blocks(anchors: DataFrame, width: int, blocks: int, salts: int) -> DataFrame:
    """One packed block of anchors for each number below blocks, and each salt; positives, if given, as a matrix of scores."""
    extra = "positives" in anchors.columns
    names = ["nth", *_BYTES, *(["positive", "positive_ids"] if extra else [])]

    def fn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = [*_pack(*(table.column(c).to_numpy() for c in ("vec_id", "label")), matrix(table.column("vector").chunk(0), width))]
        if extra:
            scores, ids = np.full((table.num_rows, POSITIVES), np.nan), np.full((table.num_rows, POSITIVES), -1, np.int64)
            for i, found in enumerate(table.column("positives").to_pylist()):
                for k, p in enumerate(found):
                    scores[i, k], ids[i, k] = p["score"], p["id"]
            packed += [binary(scores), binary(ids)]
        return pa.table([pa.array([table.column("nth")[0].as_py()], pa.int32()), *(pa.array([b], pa.binary()) for b in packed)], names=names)

    dealt = anchors.withColumn("nth", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    made = dealt.groupBy("nth").applyInArrow(fn, "nth int, " + PACKED + (", positive binary, positive_ids binary" if extra else ""))
    return made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, positives: bool) -> DataFrame:
    """anchor_id, other_id, score (and positive_id, positive_score): the first rows of each group, by task."""
    spread = rows.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = spread.join(anchors.select("nth", "salt", *(F.col(c).alias(f"of_{c}") for c in anchors.columns if c not in ("nth", "salt"))), ["nth", "salt"])
    own = [c for c in both.columns if not c.startswith("of_")]
    schema = "anchor_id long, other_id long, score double" + (", positive_id long, positive_score double" if positives else "")

    def results(anchor: Block, best: Best, positive: np.ndarray | None, ids: np.ndarray | None) -> pa.RecordBatch:
        count = positive.shape[1] if positives else 1
        out = [anchor.ids[best.group // count], best.id, best.score]
        names = ["anchor_id", "other_id", "score"]
        if positives:
            out += [ids.ravel()[best.group], positive.ravel()[best.group]]
            names += ["positive_id", "positive_score"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in own}
                if now is None or now[0] != row["nth"]:
                    if now:
                        yield results(*now[1:])
                    anchor = Block({c: batch.column(f"of_{c}")[i].as_py() for c in _BYTES})
                    positive = ids = None
                    if positives:
                        positive = np.frombuffer(batch.column("of_positive")[i].as_py(), np.float64).reshape(-1, POSITIVES)
                        ids = np.frombuffer(batch.column("of_positive_ids")[i].as_py(), np.int64)
                    best = Best(len(anchor.ids) * (POSITIVES if positives else 1), NEGATIVES if positives else POSITIVES)
                    now = row["nth"], anchor, best, positive, ids
                _, anchor, best, positive, _ = now
                if positives:
                    add_negatives(best, anchor, Block(row), positive)
                else:
                    add_positives(best, anchor, Block(row))
        if now:
            yield results(*now[1:])

    return both.mapInArrow(fn, schema)


def _long(column: str) -> Column:
    """A whole number held in a double; beyond the range of a long its nearest end."""
    return F.when(F.col(column) >= 2.0**63, F.lit(2**63 - 1)).when(F.col(column) <= -(2.0**63), F.lit(-(2**63))).otherwise(F.floor(column)).cast("long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", anchors_per_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, as `op12_hard_negatives` says.

    is_anchor tells the anchors by vec_id, label is an expression over the columns of vectors. Rows with a null id or label or
    a vector that is not finite take no part; rows that repeat a vec_id count once (least label, then least vector). Vectors of unequal length
    are compared as if filled up with zeros; an empty vector scores zero. Scores are exact while their parts stay below 2^53
    in sum, beyond that they are those of doubles, cut off at the range of a long. Tables without anchors give no rows. Anchors
    without a positive, and positives with a score below zero, have no negatives.
    """
    rows = stored(usable(vectors, id_col, vector_col, label), "negative-vectors")
    width = -(-max(1, dimensions(rows)) // SEGMENTS[-1]) * SEGMENTS[-1]
    anchors = rows.filter(is_anchor)
    blocks = max(1, -(-anchors.count() // anchors_per_block))
    salts = max(1, -(-4 * shuffle_partitions(vectors.sparkSession) // blocks))
    packed = _row_blocks(rows, width, salts)
    found = _searched(packed, _anchor_blocks(anchors, width, blocks, salts), blocks, False)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    first = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= POSITIVES), "negative-positives")
    positives = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col("other_id").alias("id")))).alias("positives"))
    ready = anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _searched(packed, _anchor_blocks(ready, width, blocks, salts), blocks, True)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), _long("positive_score").alias("positive_score"), _long("score").alias("negative_score")
    )
