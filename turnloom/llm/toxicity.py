"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by similarity.

The examples are a bounded sample of the labelled rows; all documents are scored against all of them. Features are words and
the beginnings of words, and that they occur several times, if their share differs
between the labels by more than chance. Postings are grouped in blocks of
examples; a block's largest weight per feature bounds the cosine of all its examples, and blocks are visited by falling bound
until none can change the k nearest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import remainder, text_strings

FOLDS = 5
HELD_OUT = 0  # remainder of the fold whose labels are never learned
MAX_EXAMPLES = 2_000  # labelled rows of each label that are learned from, the least hashes of the id first
MAX_FEATURES = 4_096  # the features of the largest difference between the labels
LEAST_Z = 7.0  # standard errors between the shares of a feature
NEAREST = 15
BLOCK = 64  # examples in a block of postings
PRIOR = 0.25  # weight of the base rate beside the votes
BEGINNINGS = (4, 5, 6)  # lengths of the beginnings of words that are features too
TIERS = (2, 4)  # occurrences from which a word or beginning is one more feature
WORD = re.compile(r"[^\W\d_]+")
KNOWN = 200_000  # words whose features a worker remembers


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def counted(text: str) -> Counter:
    """Features of a text and their frequencies; a tier's frequency is 1."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in features_of(word):
            found[f] += n
    found.update({f"{f}#{t}": 1 for f, n in found.items() for t in TIERS if n >= t})
    return found


@dataclass
class Index:
    """Examples by feature. bounds[f, b]: the largest weight of feature f in block b."""

    number: dict[str, int]
    idf: np.ndarray
    starts: np.ndarray  # of (feature, block) in the postings
    examples: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    ratio: tuple[float, float]  # labelled rows for each example, by label
    empty: float  # score of a text without features
    base: float  # share of label 1

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Features and weights of unit length."""
        f = np.fromiter(found, np.int64, len(found))
        w = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.idf[f]
        norm = np.sqrt((w**2).sum())
        return f, w / norm if norm > 0 else w

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, ties by example."""
        n_blocks = self.bounds.shape[1]
        bound = w @ self.bounds[f]
        order = np.argsort(-bound, kind="stable")
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        step, at = 1, 0
        while at < n_blocks and bound[order[at]] > 0:
            if len(best_s) == k and bound[order[at]] < best_s[-1] - 1e-9:
                break
            cells = (f[:, None] * n_blocks + order[at : at + step]).ravel()
            low, sizes = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
            skipped = np.cumsum(sizes) - sizes
            own = np.arange(sizes.sum()) + np.repeat(low - skipped, sizes)
            sums = np.bincount(self.examples[own], self.weights[own] * np.repeat(np.repeat(w, min(step, n_blocks - at)), sizes))
            hit = np.flatnonzero(sums)
            best_i, best_s = np.append(best_i, hit), np.append(best_s, sums[hit])
            top = np.lexsort((best_i, -np.round(best_s, 12)))[:k]
            best_i, best_s = best_i[top], best_s[top]
            at, step = at + step, step * 2
        return best_i, best_s

    def score(self, found: Counter) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of label 1 in the votes, each weighted by its cosine and by the rows that its example stands for."""
        if not found:
            return self.empty, np.zeros(0, np.int64), np.zeros(0)
        i, s = self.nearest(*self.vector(found))
        votes = s**2 * np.where(self.labels[i] == 1, *self.ratio[::-1])
        scale = PRIOR * min(self.ratio)
        return float((votes[self.labels[i] == 1].sum() + scale * self.base) / (votes.sum() + scale)), self.ids[i], s


def learn(examples: pd.DataFrame, totals: tuple[int, int]) -> Index:
    """Index of the examples (doc_id, text, toxic); totals: labelled rows that they are a sample of, by label."""
    labels = examples["toxic"].to_numpy(np.int64)
    counts = [counted(t) for t in examples["text"]]
    sizes = np.bincount(labels, minlength=2)
    df = (Counter(), Counter())
    for label, count in zip(labels, counts, strict=True):
        df[label].update(count.keys())
    z = {}
    for name in df[0].keys() | df[1].keys():
        a, b = df[1][name] + 0.5, df[0][name] + 0.5
        p, q, pooled = a / (sizes[1] + 1), b / (sizes[0] + 1), (a + b) / (sizes.sum() + 2)
        z[name] = abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / (sizes[1] + 1) + 1 / (sizes[0] + 1)))
    chosen = sorted((n for n in z if z[n] >= LEAST_Z), key=lambda n: (-z[n], n))[:MAX_FEATURES]
    number = {n: i for i, n in enumerate(chosen)}
    everywhere = np.array([df[0][n] + df[1][n] for n in chosen], float)
    index = Index(
        number, np.log((1 + len(labels)) / (1 + everywhere)) + 1, *(np.zeros(0),) * 3, np.zeros((0, 0)), labels,
        examples["doc_id"].to_numpy(np.int64), tuple(t / max(1, s) for t, s in zip(totals, sizes, strict=True)), 0.0, (totals[1] + 0.5) / (sum(totals) + 1),
    )
    own = [Counter({number[n]: c for n, c in count.items() if n in number}) for count in counts]
    without = np.array([sum(1 for o, y in zip(own, labels, strict=True) if not o and y == label) for label in (0, 1)])
    rows = without * np.array(index.ratio)
    index.empty = float((rows[1] + 0.5 * index.base) / (rows.sum() + 0.5))
    vectors = [index.vector(o) for o in own]
    f = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
    w = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
    e = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]).astype(np.int64)
    blocks = max(1, -(-len(labels) // BLOCK))
    cell = f * blocks + e // BLOCK
    order = np.lexsort((e, cell))
    index.examples, index.weights = e[order], w[order]
    index.starts = np.searchsorted(cell[order], np.arange(len(chosen) * blocks + 1))
    index.bounds = np.zeros((len(chosen), blocks))
    np.maximum.at(index.bounds, (f, e // BLOCK), w)
    return index


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """Index of at most max_examples labelled rows of each label outside the held-out fold (one for each id)."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    halves = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    picked = halves[0].union(halves[1])
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(picked), "doc_id").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    return learn(got, (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence and similarity (the nearest examples) of every row.

    A text without features, empty and null ones too, has the share of label 1 among examples without features, and no
    evidence. Repeated rows and null ids are rows of their own.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {n.split("#")[0] for n in index.number}  # words and beginnings to count
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            rows = []
            for text in text_strings(batch.column(1)):
                sums: Counter = Counter()
                for word, n in Counter(WORD.findall(text.lower())).items():
                    own = known.get(word)
                    if own is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        own = known[word] = tuple(f for f in features_of(word) if f in names)
                    for f in own:
                        sums[f] += n
                found = Counter({index.number[f]: n for f, n in sums.items() if f in index.number})
                found.update({index.number[x]: 1 for f, n in sums.items() for t in TIERS if n >= t and (x := f"{f}#{t}") in index.number})
                rows.append(index.score(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                names=["doc_id", "score", "evidence", "similarity"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(fn, "doc_id long, score double, evidence array<bigint>, similarity array<double>")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )
