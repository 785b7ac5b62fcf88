"""Token counts: every distinct pre-token is counted once and joined to the documents' pre-token frequencies.

A chunk of documents gives, for each bucket of pre-tokens, its distinct pre-tokens and a sparse table (document, pre-token,
frequency). One shuffle brings the chunks of a bucket together; there each distinct pre-token is counted once, and the
frequencies times the counts give sums per document. Token ids are never made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm.common import chunks, shuffle_partitions

CHUNK = 8 << 20  # bytes of text in a chunk
OFTEN = 0.05  # share of a chunk's documents from which a pre-token is dealt to several buckets
SPREAD = 16  # buckets of such a pre-token
KNOWN = 200_000  # pre-tokens whose normal form a worker remembers

#: The split of the word-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A chunk's first row has its ids and sizes, and the special strings in freq; the others have its part of a bucket.
DEALT = "chunk string, bucket int, ids array<bigint>, sizes binary, pieces binary, docs binary, which binary, freq binary"
DEALT_NAMES = ["chunk", "bucket", "ids", "sizes", "pieces", "docs", "which", "freq"]
DEALT_TYPES = [pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
SUMS = "chunk string, ids array<bigint>, sizes binary, tokens binary"
SUM_NAMES = ["chunk", "ids", "sizes", "tokens"]
SUM_TYPES = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Texts of these characters alone take the short way to the same pre-tokens; the others go through the library.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")


class Pieces:
    """What the library does before its merges: special strings, normal form, split. Pre-tokens are byte-level strings."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.known: dict[str, tuple[str, ...]] = {}
        self.split = regex.compile(SPLIT)

    def of_word(self, word: str) -> tuple[str, ...]:
        """Pre-tokens of a lower-case word; white space always separates them."""
        found = self.known.get(word)
        if found is None:
            found = tuple("".join(map(self.letters.__getitem__, p.encode())) for p in self.split.findall(word))
            if len(word) <= 64:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[word] = found
        return found

    def of_part(self, text: str) -> Counter:
        found: Counter = Counter()
        if UNUSUAL.search(text) is None:
            for word, n in Counter(text.lower().split()).items():
                for piece in self.of_word(word):
                    found[piece] += n
        else:
            normal = self.tokenizer.normalizer.normalize_str(text)
            found.update(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return found

    def count(self, text: str) -> tuple[int, Counter]:
        """Number of special strings, each one token, and how often each pre-token occurs in the rest."""
        if "<|" not in text or self.special.search(text) is None:
            return 0, self.of_part(text)
        found: Counter = Counter()
        for part in self.special.split(text):
            found.update(self.of_part(part))
        return len(self.special.findall(text)), found

    def tokens(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize(piece))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def pack(values: np.ndarray) -> bytes:
    """Non-negative whole numbers in the narrowest of 1, 2, 4 and 8 bytes, led by that width."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1)


def deal(
    pieces: list[bytes], docs: np.ndarray, which: np.ndarray, freq: np.ndarray, n_docs: int, buckets: int, salt: int
) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse table of a chunk by bucket of its pieces: (bucket, pieces, docs, which, freq); `which` counts from 0 in each.

    A piece in many of the chunk's documents goes to one of SPREAD buckets by chunk, so that no bucket gets all its rows.
    """
    bucket = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces))
    often = np.bincount(which, minlength=len(pieces)) > OFTEN * n_docs
    bucket = np.where(often, bucket + salt % SPREAD, bucket) % buckets
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    nth = np.empty(len(pieces), np.int64)
    nth[order] = np.arange(len(pieces)) - starts[bucket[order]]
    of_row = bucket[which]
    rows = np.argsort(of_row, kind="stable")
    ends = np.searchsorted(of_row[rows], np.arange(buckets + 1))
    for b in range(buckets):
        if starts[b] < starts[b + 1]:
            own = rows[ends[b] : ends[b + 1]]
            yield b, [pieces[i] for i in order[starts[b] : starts[b + 1]]], docs[own], nth[which[own]], freq[own]


def _deal_chunks(path: str, buckets: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        task = TaskContext.get().partitionId()
        for nth, (ids, texts) in enumerate(chunks(batches, CHUNK)):
            index: dict[str, int] = {}
            docs, which, freq, special = [], [], [], np.zeros(len(ids), np.int64)
            for i, text in enumerate(texts):
                special[i], found = model.count(text.decode())
                which.append(np.fromiter((index.setdefault(p, len(index)) for p in found), np.int64, len(found)))
                freq.append(np.fromiter(found.values(), np.int64, len(found)))
                docs.append(np.full(len(found), i))
            chunk, pieces = f"{task}-{nth}", [p.encode() for p in index]
            salt = zlib.crc32(chunk.encode())
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            rows = [(chunk, salt % buckets, ids, pack(sizes), None, None, None, pack(special))]
            for bucket, own, d, w, f in deal(pieces, np.concatenate(docs), np.concatenate(which), np.concatenate(freq), len(ids), buckets, salt):
                rows.append((chunk, bucket, None, None, b"\n".join(own), pack(d), pack(w), pack(f)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DEALT_TYPES, strict=True)], names=DEALT_NAMES)

    return fn


def _count_bucket(path: str):
    def fn(table: pa.Table) -> pa.Table:
        model = pieces_of(path)
        counts: dict[bytes, int] = {}
        rows = []
        for chunk, ids, sizes, pieces, docs, which, freq in zip(*(table.column(c) for c in DEALT_NAMES if c != "bucket"), strict=True):
            if not pieces.is_valid:
                rows.append((chunk.as_py(), ids.as_py(), sizes.as_py(), freq.as_py()))
                continue
            own = pieces.as_py().split(b"\n")
            for piece in own:
                if piece not in counts:
                    counts[piece] = model.tokens(piece.decode())
            each = np.fromiter(map(counts.__getitem__, own), np.int64, len(own))
            tokens = np.bincount(unpack(docs.as_py()), weights=unpack(freq.as_py()) * each[unpack(which.as_py())])
            rows.append((chunk.as_py(), None, None, pack(tokens.astype(np.int64))))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(SUM_TYPES)], names=SUM_NAMES)

    return fn


def _sum_chunk(table: pa.Table) -> pa.Table:
    head = next(i for i, v in enumerate(table.column("ids")) if v.is_valid)
    ids, sizes = table.column("ids")[head].values, unpack(table.column("sizes")[head].as_py())
    total = np.zeros(len(ids), np.int64)
    for blob in table.column("tokens"):
        part = unpack(blob.as_py())
        total[: len(part)] += part.astype(np.int64)
    return pa.table([ids, pa.array(sizes.astype(np.int64)), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, as the tokenizer file at `path` gives them without added tokens.

    Special strings in a text count as one token each, as the library has it. A null text is empty and has no tokens;
    repeated rows and null ids are rows of their own. A document must fit in a task.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    dealt = rows.mapInArrow(_deal_chunks(path, buckets), DEALT)
    sums = dealt.groupBy("bucket").applyInArrow(_count_bucket(path), SUMS)
    return sums.groupBy("chunk").applyInArrow(_sum_chunk, "doc_id long, n_bytes long, n_tokens long")
