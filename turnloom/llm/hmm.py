"""Language-model scores by a hidden Markov model over word classes, beside a smoothed unigram base.

Words are counted over all training texts. A word of the FREQUENT commonest, and the end, is a class of its own; any other
word belongs to one of HASHED classes by its hash. States emit classes, and a class emits its words by their counts, one
share of each hashed class being kept for words never seen: P(word | state) = P(class | state) * P(word | class). So the model
has a fixed size, while the counts grow with the corpus and stay in a table.

Training is Baum-Welch: every round each partition gives its expected counts by class and state, which are summed across
partitions. Long texts are learned in pieces of PIECE tokens; a later piece starts from the mean share of the states. Scores
use the scaled forward recursion over the whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import chunks, remainder, remainder_of, shuffle_partitions, stored, text_bytes
from turnloom.llm.token_counts import deal, pack, unpack

MODULUS, HELD_OUT = 7, 2
FREQUENT = 4_096
HASHED = 4_096
STATES = 8
ROUNDS = 3  # over all training texts
WARM_ROUNDS = 12  # over the first pieces of WARM training texts drawn by the hash of their ids, which the first model comes from
WARM = 400
PIECE = 1_024
CHUNK = 16 << 20  # bytes of text in a chunk
FLUSH = 400_000  # distinct words that a task gathers before it passes on their counts
SMOOTH = 0.05  # added to expected counts, per class in proportion to its share
END = 0  # class of the end


@dataclass
class Model:
    start: np.ndarray  # states
    mean: np.ndarray  # states, over all tokens
    move: np.ndarray  # states, states
    emit: np.ndarray  # classes, states


def time_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling length, and how many of them have a token at each time."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")


def forward(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of every text: scaled forward recursion, all texts of a chunk side by side."""
    order, active = time_order(lengths)
    out = np.zeros(len(lengths))
    first = starts[order]
    alpha = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, n in enumerate(active.tolist()):
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[codes[first[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, ...]:
    """Expected counts of a set of pieces: starts, moves, emissions. heads: whether a piece begins its text."""
    k = len(model.start)
    order, active = time_order(lengths)
    first, heads = starts[order], heads[order]
    begin = np.where(heads[:, None], model.start, model.mean).astype(np.float32)
    move = model.move.astype(np.float32)
    emit = model.emit.astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum(active)])
    where = np.concatenate([first[:n] + t for t, n in enumerate(active.tolist())]) if len(active) else np.zeros(0, np.int64)
    own = codes[where]
    alphas = np.empty((len(own), k), np.float32)
    scales = np.empty(len(own), np.float32)
    for t, n in enumerate(active.tolist()):
        a, b = offsets[t], offsets[t + 1]
        now = (alphas[offsets[t - 1] : offsets[t - 1] + n] @ move if t else begin[:n]) * emit[own[a:b]]
        scales[a:b] = now.sum(axis=1)
        alphas[a:b] = now / scales[a:b, None]
    moves = np.zeros((k, k))
    beta = np.zeros((0, k), np.float32)
    for t in range(len(active) - 1, -1, -1):
        a, b = offsets[t], offsets[t + 1]
        n = b - a
        full = np.ones((n, k), np.float32)
        if len(beta):
            full[: len(beta)] = beta @ move.T
            moves += alphas[a : a + len(beta)].T.astype(np.float64) @ beta
        gamma = alphas[a:b] * full
        beta = emit[own[a:b]] * full / scales[a:b, None]
        alphas[a:b] = gamma / gamma.sum(axis=1, keepdims=True)
    heads_gamma = alphas[: len(order)][heads[: len(order)]].sum(axis=0, dtype=np.float64) if len(order) else np.zeros(k)
    emits = np.stack([np.bincount(own, alphas[:, s], len(model.emit)) for s in range(k)], axis=1) if len(own) else np.zeros((len(model.emit), k))
    return heads_gamma, moves * model.move, emits


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
    """The model of the expected counts; share (of the classes in the training tokens) smooths the emissions."""
    k = len(start)
    emit = emit + SMOOTH * len(share) * share[:, None]
    mean = emit.sum(axis=0)
    return Model((start + 1 / k) / (start.sum() + 1), mean / mean.sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit / mean)


def pieces(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into pieces of at most PIECE tokens: starts, lengths, whether the piece begins its text."""
    n = -(-lengths // PIECE)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(starts, n) + nth * PIECE
    return begin, np.minimum(np.repeat(starts + lengths, n) - begin, PIECE), nth == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes) and n over the training rows of (doc_id, text); the end is not a word and not counted here."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                found.update(text.lower().split())
                if len(found) > FLUSH:
                    yield passed()
                    found.clear()
        yield passed()

    training = docs.filter(remainder(F.col("doc_id"), MODULUS) != HELD_OUT)
    return training.select("text").mapInArrow(fn, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


CODED = (
    "chunk string, ids array<bigint>, training binary, lengths binary, codes binary, common double_array, known binary, "
    "parts array<struct<bucket:int,words:binary,docs:binary,which:binary,freq:binary>>"
).replace("double_array", "array<double>")
PART = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("which", pa.binary()), ("freq", pa.binary())]))
CODED_TYPES = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.list_(pa.float64()), pa.binary(), PART]
CODED_NAMES = ["chunk", "ids", "training", "lengths", "codes", "common", "known", "parts"]


def class_of(word: bytes) -> int:
    """Class of a word that is not frequent."""
    return FREQUENT + 1 + zlib.crc32(word) % HASHED


def code_texts(frequent: dict[bytes, tuple[int, int]], buckets: int):
    """Chunks of texts as classes, with the sums over frequent words and the table of the others, by bucket."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        classes = {w: c for w, (c, _) in frequent.items()}
        logs = np.zeros(len(frequent) + 1)
        for c, n in frequent.values():
            logs[c] = math.log10(n + 1)
        for nth, (ids, texts) in enumerate(chunks(batches, CHUNK)):
            index: dict[bytes, int] = {}
            own_class: list[int] = []
            lengths, codes, common, known, docs, which, freq = [], [], [], [], [], [], []
            for i, text in enumerate(texts):
                words = text.lower().split()
                code = np.fromiter(map(classes.get, words, repeat(-1)), np.int64, len(words))
                other = np.flatnonzero(code < 0)
                common.append(float(logs[code[code >= 0]].sum()))
                known.append(len(words) - len(other))
                at = []
                for j in other.tolist():
                    word = words[j]
                    number = index.get(word)
                    if number is None:
                        number = index[word] = len(index)
                        own_class.append(class_of(word))
                    at.append(number)
                at = np.array(at, np.int64)
                code[other] = -1 - at
                lengths.append(len(words) + 1)
                codes.append(np.append(code, END))
                numbers, times = np.unique(at, return_counts=True)
                docs.append(np.full(len(numbers), i))
                which.append(numbers)
                freq.append(times)
            coded = np.concatenate(codes)
            unknown = np.flatnonzero(coded < 0)
            coded[unknown] = np.array(own_class, np.int64)[-1 - coded[unknown]]
            chunk = f"{task}-{nth}"
            dealt = deal(list(index), *map(np.concatenate, (docs, which, freq)), len(ids), buckets, 0)
            parts = [{"bucket": b, "words": b"\n".join(w), "docs": pack(d), "which": pack(h), "freq": pack(f)} for b, w, d, h, f in dealt]
            training = pack(np.array([remainder_of(i, MODULUS) != HELD_OUT for i in ids], np.int64))
            row = [chunk, ids, training, pack(np.array(lengths)), coded.astype(np.uint16).tobytes(), common, pack(np.array(known)), parts]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, CODED_TYPES, strict=True)], names=CODED_NAMES)

    return fn


def _other_sums(key: tuple, tables: pa.Table, counts: pa.Table) -> pa.Table:
    """For the words of a bucket: sums over each chunk's texts of log10(c + 1), and of the words that were counted."""
    count = dict(zip(counts.column("word").to_pylist(), counts.column("n").to_pylist(), strict=True))
    rows = []
    for chunk, words, docs, which, freq in zip(*(tables.column(c).to_pylist() for c in ("chunk", "words", "docs", "which", "freq")), strict=True):
        own = words.split(b"\n")
        c = np.fromiter(map(count.get, own, repeat(0)), np.int64, len(own))[unpack(which)]
        docs, freq = unpack(docs), unpack(freq)
        logs = np.bincount(docs, freq * np.log10(c + 1.0))
        known = np.bincount(docs, freq * (c > 0)).astype(np.int64)
        rows.append((chunk, logs, pack(known)))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.list_(pa.float64()), pa.binary()))], names=["chunk", "logs", "known"])


def _chunk_sums(table: pa.Table) -> pa.Table:
    size = max(len(v) for v in table.column("logs"))
    logs, known = np.zeros(size), np.zeros(size, np.int64)
    for a, b in zip(table.column("logs"), table.column("known"), strict=True):
        part = a.values.to_numpy()
        logs[: len(part)] += part
        part = unpack(b.as_py())
        known[: len(part)] += part.astype(np.int64)
    return pa.table([pa.array([table.column("chunk")[0].as_py()]), pa.array([logs], pa.list_(pa.float64())), pa.array([pack(known)], pa.binary())], names=["chunk", "logs", "known"])


def _spans(lengths: np.ndarray) -> np.ndarray:
    lengths = lengths.astype(np.int64)
    return np.cumsum(lengths) - lengths


def _pieces_of(row_lengths: bytes, training: bytes, codes: bytes) -> tuple[np.ndarray, ...]:
    lengths = unpack(row_lengths).astype(np.int64)
    learned = unpack(training).astype(bool)
    return np.frombuffer(codes, np.uint16), *pieces(_spans(lengths)[learned], lengths[learned])


def _expected_counts(model: Model):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
        for batch in batches:
            for lengths, training, codes in zip(*(batch.column(c) for c in range(3)), strict=True):
                s, m, e = expected(model, *_pieces_of(lengths.as_py(), training.as_py(), codes.as_py()))
                start, move, emit = start + s, move + m, emit + e
        table = np.concatenate([start[None], move, emit])
        some = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(some), *(pa.array(table[some, s]) for s in range(k))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", *(f"s{s}" for s in range(k))])

    return fn


def first_model(texts: list[np.ndarray], share: np.ndarray, states: int = STATES) -> Model:
    """A model learned from a few texts, from a start in which states keep to themselves and texts lean to one state each."""
    rng = np.random.default_rng(7)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.concatenate(texts) if texts else np.zeros(0, np.uint16)
    lean = np.repeat(rng.dirichlet(np.full(states, 0.3), len(texts)), lengths, axis=0) if texts else np.zeros((0, states))
    emit = np.stack([np.bincount(codes, lean[:, s], len(share)) for s in range(states)], axis=1)
    move = 20.0 * np.eye(states) + 1
    model = maximise(np.ones(states), move, emit, share)
    for _ in range(WARM_ROUNDS if texts else 0):
        model = maximise(*expected(model, codes, *pieces(_spans(lengths), lengths)), share)
    return model


def _least_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pieces of a task's WARM training texts whose ids have the least hash."""
    least: list[tuple[int, bytes]] = []
    for batch in batches:
        for keys, sizes, training, coded in zip(*(batch.column(c) for c in range(4)), strict=True):
            codes, starts, lengths, heads = _pieces_of(sizes.as_py(), training.as_py(), coded.as_py())
            ids = [key for key, learned in zip(keys.as_py(), unpack(training.as_py()), strict=True) if learned]
            first = zip(ids, starts[heads], lengths[heads], strict=True)
            least += [(place_of(key), codes[s : s + n].tobytes()) for key, s, n in first]
            least = sorted(least)[:WARM]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in least], pa.int64()), pa.array([c for _, c in least], pa.binary())], names=["place", "codes"])


def place_of(doc_id: int | None) -> int:
    """Where an id stands in the draw of the first texts; nothing but the id decides it."""
    return xxhash.xxh64_intdigest(b"" if doc_id is None else str(doc_id).encode(), seed=WARM) >> 1


def first_texts(coded: DataFrame) -> list[np.ndarray]:
    """First pieces of the WARM training texts of the whole table whose ids have the least hash, ties by their codes.

    The draw depends on the rows alone, not on files, chunks or tasks. At most WARM pieces leave a task.
    """
    drawn = coded.select("ids", "lengths", "training", "codes").mapInArrow(_least_texts, "place long, codes binary")
    return [np.frombuffer(r["codes"], np.uint16) for r in drawn.orderBy("place", "codes").limit(WARM).collect()]


def learn(coded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the stored chunks. Each round sums a row of bounded size per class over the partitions."""
    training = coded.select("lengths", "training", "codes")
    texts = first_texts(coded)
    model = first_model(texts, share, states)
    names = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        given = training.mapInArrow(_expected_counts(model), "at long, " + ", ".join(f"{n} double" for n in names))
        sums = given.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        table = np.zeros((1 + states + len(share), states))
        table[sums["at"].to_numpy()] = sums[names].to_numpy()
        model = maximise(table[0], table[1 : states + 1], table[states + 1 :], share)
    return model


def _final(model: Model, per_token: np.ndarray, n_words: int, n_distinct: int):
    """per_token: log10 of what a class's words share, taken off the words' own logs."""
    floor = math.log10(n_words + n_distinct + 1) if n_words else 0.0

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, known = (unpack(row[c]).astype(np.int64) for c in ("lengths", "known"))
                codes, starts = np.frombuffer(row["codes"], np.uint16), _spans(lengths)
                states = forward(model, codes, starts, lengths) / math.log(10)
                shared = np.add.reduceat(per_token[codes], starts) if len(starts) else np.zeros(0)
                n = len(lengths)
                other, other_known = np.zeros(n), np.zeros(n, np.int64)
                if row["logs"] is not None:
                    other[: len(row["logs"])] = row["logs"]
                    part = unpack(row["other_known"])
                    other_known[: len(part)] = part
                base = np.array(row["common"]) + other
                learned = unpack(row["training"]).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(~learned), pa.array(lengths), pa.array(known + other_known),
                        pa.array(base), pa.array(states + other - shared),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
                )

    return fn, floor


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: their one token is the end. Null ids count as the empty text where rows are parted; repeated rows
    are learned from and scored each. Without training rows every token is unknown and both scores come from the smoothing.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stored(word_counts(rows), "words")
    ends = rows.filter(remainder(F.col("doc_id"), MODULUS) != HELD_OUT).count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, distinct + (ends > 0)
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    frequent = {w: (i + 1, c) for i, (w, c) in enumerate(top)}

    listed = docs.sparkSession.createDataFrame([(w,) for w, _ in top], "word binary")
    others = counts.join(F.broadcast(listed), "word", "left_anti")
    crc = F.crc32("word")
    per_class = others.groupBy((crc % HASHED).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    size = np.zeros(FREQUENT + 1 + HASHED)
    shared = np.zeros(len(size))
    size[END] = ends
    for c, k in frequent.values():
        size[c] = k
        shared[c] = 0.0
    hashed = np.ones(HASHED)  # one share for words never seen
    for r in per_class:
        size[FREQUENT + 1 + r["c"]] = r["n"]
        hashed[r["c"]] += r["n"] + r["d"]
    shared[FREQUENT + 1 :] = np.log10(hashed)
    share = (size + 1) / (size + 1).sum()

    coded = stored(rows.mapInArrow(code_texts(frequent, buckets), CODED), "codes")
    model = learn(coded, share)

    parts = coded.select("chunk", F.explode("parts").alias("part")).select("chunk", "part.*")
    dealt = others.withColumn("bucket", (crc % buckets).cast("int"))
    sums = parts.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_other_sums, "chunk string, logs array<double>, known binary")
    sums = sums.groupBy("chunk").applyInArrow(_chunk_sums, "chunk string, logs array<double>, known binary").withColumnRenamed("known", "other_known")
    fn, floor = _final(model, shared, n, v)
    joined = coded.drop("parts").join(sums, "chunk", "left")
    scored = joined.mapInArrow(fn, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    end = math.log10(ends + 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )
