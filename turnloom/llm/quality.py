"""Quality rules: counts of a text, two fixed rules, and gradient-boosted trees over the statistics.

The trees are flattened into node arrays of numpy and score a batch of documents level by level. Chosen statistics have a
monotonic constraint: more repetition or more symbols never raise the quality.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
RUN = 8  # words of a window that must not repeat
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MAX_ROWS = 20_000  # labelled rows that the trees learn from, the least hashes of the id first

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the trees, and whether more of it may only lower (-1) or raise (1) the quality; 0: free.
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "distinct": 0, "commonest": -1, "upper": 0,
    "digits": 0, "marks": 0, "exclaimed": -1, "bars": -1, "line_words": 0, "after_marks": 0, "neighbours": -1, "no_letter": 0,
}
CONSTRAINTS = np.array(list(STATISTICS.values()))


def repeated_words(ids: np.ndarray, run: int = RUN) -> int:
    """Words inside a window of `run` words that occurs twice or more, the first time included."""
    n = len(ids) - run + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for j in range(run):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype(np.uint64) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, run)
    pairs = np.flatnonzero(same)
    if not np.array_equal(windows[order[pairs]], windows[order[pairs + 1]]):  # different windows with one hash
        _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = counts[inverse.ravel()] > 1
    else:
        starts = np.zeros(n, bool)
        starts[order[pairs]] = starts[order[pairs + 1]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(starts), 1)
    np.add.at(edges, np.flatnonzero(starts) + run, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _left(text: bytes, without: bytes) -> int:
    return len(text.translate(None, without))


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the statistics of a text (UTF-8)."""
    words = text.split()
    n = len(words)
    chars = len(text.decode())
    n_spaces = len(text) - _left(text, SPACES)
    symbols = len(text) - _left(text, SYMBOLS)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(ids)
    counts = [n, chars - n_spaces, symbols, dup_lines, repeated]
    if n == 0:
        return counts, [0.0] * len(STATISTICS)
    word_chars = max(1, chars - n_spaces)
    upper = len(text) - _left(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = len(text) - _left(text, b"0123456789")
    ends = Counter(w[-1] for w in words)
    letterless = sum(v for k, v in Counter(words).items() if not k.strip(b"0123456789.,;:!?|*#$%&<>()-+=\"'"))
    return counts, [
        float(np.log1p(n)), word_chars / n, symbols / word_chars, dup_lines / len(lines), repeated / n, len(index) / n,
        np.bincount(ids).max() / n, upper / word_chars, digits / word_chars, (len(text) - _left(text, b".,;:?")) / n,
        text.count(b"!") / n, text.count(b"|") / n, float(np.log1p(n / len(lines))), (ends[46] + ends[63]) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, letterless / n,
    ]


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(
    x: np.ndarray, y: np.ndarray, constraints: np.ndarray = CONSTRAINTS, trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 32, least: float = 5.0, ridge: float = 1.0,
) -> Trees:
    """Boosted trees on log loss with histograms. A child of a constrained split keeps to its side of the split's middle value,
    and so do all nodes below it. Without rows, or with one label only, the trees are a constant."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.999
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    raw = np.full(len(x), start)

    def grow(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + ridge), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, value * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f in range(x.shape[1]) if level < depth and len(rows) else ():
            if not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(edges[f]) + 1))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + g * value + 0.5 * (h + ridge) * value**2
            gain[(hl < least * 0.1) | (hr < least * 0.1)] = -np.inf
            if constraints[f]:
                gain[(vr - vl) * constraints[f] < 0] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            raw[rows] += value * rate
            return me
        _, f, k, vl, vr = best
        go = binned[rows, f] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(constraints[f]), ((low, high),) * 2)
        nodes[me][:2] = [f, float(edges[f][k])]
        nodes[me][2] = grow(rows[go], level + 1, *bounds[0], grad, hess)
        nodes[me][3] = grow(rows[~go], level + 1, *bounds[1], grad, hess)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    table = np.array(nodes)
    whole = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(np.array(roots), whole[:, 0], table[:, 1], whole[:, 1], whole[:, 2], table[:, 4], start, depth)


MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", statistics array<double>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, statistics = [], []
        for text in text_bytes(batch.column(1)):
            c, s = measure(text)
            counts.append(c)
            statistics.append(s)
        table = np.array(counts, np.int64).reshape(len(counts), len(COUNTS))
        columns = [batch.column(0), *(pa.array(table[:, i]) for i in range(len(COUNTS))), pa.array(statistics, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["doc_id", *COUNTS, "statistics", *batch.schema.names[2:]])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees for labels.quality. They learn from at most max_rows labelled rows (one for each id, least hashes first)."""
    picked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    rows = texts.mapInArrow(_measured, MEASURED + ", quality int")
    got = rows.select("doc_id", "quality", "statistics").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["statistics"].tolist()).reshape(len(got), len(STATISTICS))
    return fit(x, got["quality"].to_numpy(float))


FAILED = "n_words < {least} OR 100 * n_repeat_words > {most} * n_words".format(least=LEAST_WORDS, most=MOST_REPEATED)


def _scored(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in _measured(batches):
        x = np.array(batch.column("statistics").to_pylist()).reshape(batch.num_rows, len(STATISTICS))
        yield batch.set_column(batch.schema.get_field_index("statistics"), "score", pa.array(trees.probability(x)))


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of every row.

    A null text has no words and fails; repeated rows and null ids are rows of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    scored = rows.mapInArrow(lambda batches: _scored(batches, trees), MEASURED.replace("statistics array<double>", "score double"))
    return scored.withColumn("base_failed", F.expr(FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns."""
    at = docs.columns.index("text")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], names=["doc_id", "text"])
            for scored in _scored([pair], trees):
                n, repeated, score = (scored.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words", "score"))
                yield batch.filter(pa.array((n >= LEAST_WORDS) & (100 * repeated <= MOST_REPEATED * n) & (score >= threshold)))

    return docs.mapInArrow(fn, docs.schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "score")
