"""BPE encoding and decoding with forced boundaries.

A merge makes a token of the vocabulary. Where two neighbouring bytes occur side by side in no token, no merge can reach
across: the text can be cut there, and the fragments encoded one by one give the ids of the whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm.common import text_strings
from turnloom.llm.token_counts import UNUSUAL, byte_letters

KNOWN = 250_000  # pre-tokens that a worker remembers
SLICE = 1 << 20  # characters that are split at a time
#: The split of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

class Coder:
    """Encodes texts and decodes ids of a byte-level vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        back = {c: b for b, c in letters.items()}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        seen = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.bytes[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
            if i not in added:
                raw = np.frombuffer(self.bytes[i], np.uint8)
                seen[raw[:-1], raw[1:]] = True
        self.forced = ~seen  # byte pairs that mark a certain cut
        self.special = {s: np.array([i], "<u4").tobytes() for i, s in added.items()}
        self.found = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.split = regex.compile(SPLIT)
        self.place = regex.compile(r"(?<=\S)(?= \S)")
        self.back = str.maketrans({c: b for b, c in letters.items()})
        self.known: dict[str, bytes] = {}  # ids of pre-tokens

    def cuts(self, raw: bytes) -> np.ndarray:
        """The places of the forced boundaries."""
        values = np.frombuffer(raw, np.uint8)
        return np.flatnonzero(self.forced[values[:-1], values[1:]]) + 1

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: each is cut at its forced boundaries, its fragments are encoded one by one and joined."""
        raw = b"".join(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        places = np.union1d(self.cuts(raw), np.append(0, ends))
        letters = raw.decode("latin-1").translate(self.letters)
        fragments = [letters[a:b] for a, b in pairwise(places.tolist())]
        model = self.tokenizer.model
        of = {f: array("I", [t.id for t in model.tokenize(f)]).tobytes() for f in set(fragments)}
        ids = [of[f] for f in fragments]
        return [b"".join(ids[a:b]) for a, b in pairwise([0, *np.searchsorted(places, ends).tolist()])]

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut before a space between two other characters, where the split always cuts."""
        at = 0
        while len(text) - at > SLICE:
            cut = self.place.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def of_pieces(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens, those not known encoded together."""
        known = self.known
        if new := list(set(pieces).difference(known)):
            known.update(zip(new, self.encoded([p.encode() for p in new]), strict=True))
        ids = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > 32:
                del known[piece]
        if len(known) > KNOWN:
            for piece in list(islice(known, KNOWN // 2)):
                del known[piece]
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if not text:
            return b""
        if UNUSUAL.search(text) is not None:
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return b"".join(self.encoded([bytes(map(ord, p.translate(self.back))) for p, _ in found]))
        return self.of_pieces(self.split.findall(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self.found.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(map(self.plain, self.slices(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder_of(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of every row.

    A special string in a text is its one id, as the library has it. A null text is empty and has no ids; repeated rows and
    null ids are rows of their own.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            ids = pa.array([coder.encode(t) for t in text_strings(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(fn, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids give; null ids give the empty text."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            texts = pa.array([coder.decode(v.as_py() or b"") for v in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(fn, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode` of `encode` in one pass, so that a task needs one worker with the vocabulary instead of two."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            ids = [coder.encode(t) for t in text_strings(batch.column(1))]
            texts = pa.array(map(coder.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), texts], names=["doc_id", "ids", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(fn, "doc_id long, ids binary, text string")


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and the digests of both."""
    return round_trip(docs, path, id_col, text_col).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
