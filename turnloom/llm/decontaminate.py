"""Benchmark decontamination: n-gram seeds propose (document, item, place), Smith-Waterman alignment scores them.

Every n-gram of an item makes seeds, however many documents have it: copies raise the counts of the very n-grams they keep.
A passage around each seed is aligned with the item's words, with gaps and replaced words, so edited and paraphrased copies
score too. Passages that share too few words with the item to reach the least score are not aligned; nothing else is left out.

Items are broadcast in blocks of a bounded number of words; each block is one pass over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import text_strings

GRAM = 3  # words of a seed
ITEM_WORDS = 400_000  # words of the items in a block
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.33  # least score, as a share of an item that matches whole
LEAST_WORDS = 8  # words that must match at least; shorter items must match whole
BATCH = 512  # alignments at a time
#: ASCII marks separate words like white space does.
APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8."""
    return text.lower().encode().translate(APART).split()


@dataclass
class Items:
    """Items as numbers of words; a word that no item has is number 0."""

    ids: list
    words: list[np.ndarray]
    number: dict[bytes, int]
    grams: dict[int, list[tuple[int, int]]]  # code of an n-gram: item, place

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def code(self, numbers: np.ndarray) -> np.ndarray:
        """Codes of all n-grams of a text, -1 where a word is unknown. A text shorter than GRAM is one n-gram with gaps."""
        n = len(numbers) - GRAM + 1
        base = len(self.number) + 1
        if n < 1:
            return np.zeros(0, np.int64)
        code = np.zeros(n, np.int64)
        known = np.ones(n, bool)
        for j in range(GRAM):
            code = code * base + numbers[j : n + j]
            known &= numbers[j : n + j] > 0
        return np.where(known, code, -1)


def items_of(rows: list[tuple]) -> Items:
    """Items of (id, text) rows. Items of fewer words than an n-gram have no seeds and are left out."""
    split = [(i, words_of(t or "")) for i, t in rows]
    split = [(i, w) for i, w in split if len(w) >= GRAM]
    number: dict[bytes, int] = {}
    for _, words in split:
        for w in words:
            number.setdefault(w, len(number) + 1)
    items = Items([i for i, _ in split], [], number, defaultdict(list))
    if (len(number) + 1) ** GRAM >= 1 << 62:
        raise ValueError("a block of items has too many words")
    for at, (_, words) in enumerate(split):
        numbers = np.array([number[w] for w in words], np.int64)
        items.words.append(numbers)
        for place, code in enumerate(items.code(numbers).tolist()):
            items.grams[code].append((at, place))
    return items


def align(item: list[np.ndarray], passage: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman for many pairs at once, by anti-diagonals: best score, its end in the passage, words that match.

    The matching words are counted along the best path into each cell.
    """
    n, width, depth = len(item), max(map(len, item)), max(map(len, passage))
    a = np.full((n, width), -1)
    b = np.full((n, depth), -2)
    for i, (x, y) in enumerate(zip(item, passage, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    a[a == 0] = -1
    scale = 1 << 20  # a cell holds score * scale + matching words
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last = np.zeros((n, width + 1), np.int64)
    before = np.zeros((n, width + 1), np.int64)
    flipped = np.concatenate([np.full((n, width), -3), b, np.full((n, width), -3)], axis=1)[:, ::-1]
    for d in range(width + depth - 1):
        # cell (i, j) with i + j = d lies at i + 1; b[j] for i = 0.. is a slice of the flipped passage
        at = flipped.shape[1] - 1 - (d + width)
        same = a == flipped[:, at : at + width]
        step = before[:, :-1] + np.where(same, MATCH * scale + 1, MISMATCH * scale)
        cell = np.maximum(np.maximum(step, np.maximum(last[:, :-1], last[:, 1:]) + GAP * scale), 0)
        cell[cell < scale] = 0
        top = cell.max(axis=1)
        better = top > best
        end[better] = d - cell[better].argmax(axis=1)
        best = np.maximum(best, top)
        before, last = last, np.concatenate([np.zeros((n, 1), np.int64), cell], axis=1)
    return best // scale, end, best % scale


def _enough(score: float, same: int, size: int) -> bool:
    return score >= THRESHOLD * MATCH * size and same >= min(size, LEAST_WORDS)


class Seeds:
    """The places of every n-gram in the items, as sorted arrays."""

    def __init__(self, items: Items):
        self.items = items
        self.codes = np.array(sorted(items.grams), np.int64)
        places = [items.grams[c] for c in self.codes.tolist()]
        self.ends = np.cumsum([0, *map(len, places)])
        self.item, self.place = np.array([x for p in places for x in p], np.int64).T
        self.bags = [np.unique(w, return_counts=True) for w in items.words]

    def starts(self, numbers: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items that share an n-gram with the text, each with the distinct places where it would begin, in order."""
        found = self.items.code(numbers)
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        hits = np.flatnonzero(self.codes[at] == found)
        first = self.ends[at[hits]]
        many = self.ends[at[hits] + 1] - first
        seed = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        if not len(seed):
            return
        pairs = np.unique(np.stack([self.item[seed], np.repeat(hits, many) - self.place[seed]]), axis=1)
        cuts = np.flatnonzero(np.diff(pairs[0])) + 1
        for item, starts in zip(pairs[0, [0, *cuts]].tolist(), np.split(pairs[1], cuts), strict=True):
            yield item, starts.tolist()

    def may_score(self, item: int, passage: np.ndarray) -> bool:
        """False if the words that the passage shares with the item, in any order, could not score enough."""
        words, counts = self.bags[item]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        there = np.bincount(at[words[at] == passage], minlength=len(words))
        same = int(np.minimum(there, counts).sum())
        return _enough(MATCH * same, same, len(self.items.words[item]))


def _score(pending: list[tuple], items: Items) -> Iterator[tuple]:
    """Rows of the pending (doc, at, item, words, low) whose passage scores enough."""
    pending.sort(key=lambda p: (len(items.words[p[2]]), len(p[3])))
    for i in range(0, len(pending), BATCH):
        part = pending[i : i + BATCH]
        best, end, same = align([items.words[p[2]] for p in part], [p[3] for p in part])
        for (doc, row, item, _, low), s, e, m in zip(part, best.tolist(), end.tolist(), same.tolist(), strict=True):
            size = len(items.words[item])
            if _enough(s, m, size):
                yield doc, row, items.ids[item], s / (MATCH * size), m, low + e + 1


MATCHES = "doc_id long, item_id long, score double, n_matching long, end_word long"


def _matches(items: Items):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items)
        for batch in batches:
            pending, rows = [], []
            best: dict[tuple, tuple] = {}
            for row, (key, text) in enumerate(zip(batch.column(0), text_strings(batch.column(1)), strict=True)):
                numbers = items.numbers(text)
                for item, starts in seeds.starts(numbers):
                    size = len(items.words[item])
                    done = -1
                    for start in starts:
                        low = max(0, start - size // 2)
                        if start + size <= done:
                            continue
                        done = min(len(numbers), start + size + size)
                        if seeds.may_score(item, numbers[low:done]):
                            pending.append((key.as_py(), row, item, numbers[low:done], low))
                if len(pending) >= 8 * BATCH:
                    rows.extend(_score(pending, items))
                    pending = []
            rows.extend(_score(pending, items) if pending else ())
            for doc, row, item, score, same, end in rows:
                best[row, item] = max(best.get((row, item), (doc, item, -1.0, 0, 0)), (doc, item, score, same, -end), key=lambda r: r[2:])
            out = [(d, i, s, m, -e) for d, i, s, m, e in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "n_matching", "end_word"])

    return fn


def item_blocks(benchmark: DataFrame, most_words: int = ITEM_WORDS) -> Iterator[list[tuple]]:
    """The items in blocks of a bounded size, each read by itself."""
    some = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct()
    size = some.agg(F.coalesce(F.sum(F.size(F.split("text", r"\W+")) + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (most_words // 2)))
    for block in range(blocks):
        own = some if blocks == 1 else some.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in own.collect()]
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_matching and end_word: the best alignment of each row of docs with each item it contains.

    score is the share of the item's words that align (edits cost), end_word the word after the passage. Null and empty texts
    match nothing; repeated rows and null ids match as rows of their own. Items that are empty, null or of fewer than GRAM
    words are not searched.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    found = spark.createDataFrame([], MATCHES)
    for block in item_blocks(benchmark):
        items = items_of(block)
        if not items.grams:
            continue
        found = found.union(rows.mapInArrow(_matches(items), MATCHES))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns; rows that share an id with one that does go too."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["found_id"]), "left_anti")
