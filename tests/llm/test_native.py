"""Personal data and sharding against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import pii, sharding

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return 12 <= len(digits) <= 19 and total % 10 == 0


CHECK = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": luhn,
    "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15,
}


def brute(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if CHECK[k](m.group())]
    return [s for _, _, s in sorted(found)]


HAND = [
    None, "", " ", "a@b.c@d.e", "a@b.c+x@d.e", "a..b@c-d..e", "a@b..c x@y.z.", "_%@a.b-", "@a.b", "a@.b c@d", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1",
    "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111  1111-1111", "4111 1111 1111 1111 - 1", "1 -4111111111111111", "4111111111111111-", "x4111111111111111y",
    "+1 (555) 123-4567, +12 +1234567890123456", "++1 23 456 789 0(", "é👍 +1 234 567 890 ü a@b.cd 👍 10.0.0.1", "GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432",
    "my ssn is 123-45-6789", "code 123-45-6789", "a@b." * 50, "1.1.1.1 " * 1500, "a@" + "b." * 20000 + "c", "1 " * 20000, "7" * 6000, "a" * 6000, "+" * 2000 + "1" * 2000,
]


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    made = ["".join(random.choice("0123456789 -.+()@abé") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    return HAND + made + made[:50]


def test_base_spans_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, found string")
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in BASE] == want, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]


def test_added_kinds_need_checksum_or_context(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HAND)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    assert spans[HAND.index("my ssn is 123-45-6789")] == "ssn:10:21"
    assert "ssn" not in spans[HAND.index("code 123-45-6789")]
    iban = spans[next(i for i, t in enumerate(HAND) if t and t.startswith("GB82"))]
    assert iban.count("iban") == 1 and "iban:0:27" in iban


FOLLOWED = {
    "BE68 5390 0754 7034 paid": [(0, 19)], "BE68 5390 0754 7034 I paid": [(0, 19)], "BE68539007547034 I paid": [(0, 16)],
    "ES91 2100 0418 4502 0005 1332 IBAN": [(0, 29)], "to BE68 5390 0754 7034 BE68 5390 0754 7034 NOW": [(3, 22), (23, 42)],
    "XY12 CODE BE68 5390 0754 7034 OK": [(10, 29)], "NO93 8601 1117 947 A1": [(0, 18)], "DE89 3704 0044 0532 0130 00 EUR": [(0, 27)],
    "BE68 5390 0754 7035 I paid": [], "xBE68539007547034": [], "BE685390075470341": [],
}


def test_account_numbers_before_words(spark):
    docs = spark.createDataFrame(list(enumerate(FOLLOWED)), "doc_id long, text string")
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.pii_digest(docs).collect()}
    for i, (text, want) in enumerate(FOLLOWED.items()):
        assert spans[i] == [f"iban:{a}:{b}" for a, b in want], text


def test_every_found_span_is_masked(spark, texts):
    made = [*texts, *FOLLOWED, "my ssn is 123-45-6789, é👍 a@b.cd " * 400, "x" * 511 + " 10.0.0.1", "é" * 512 + " a@b.cd" + "z " * 600 + "10.0.0.1", "+1 4111 1111 1111 1111"]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(made)], "doc_id long, text string, found string, n_chars long")
    got = {r.doc_id: r for r in pii.mask_found(docs).collect()}
    assert pii.mask_found(docs).columns == docs.columns and len(got) == len(made)
    seen = set()
    for row in pii.find_pii(docs).collect():
        text, want, at = made[row.doc_id] or "", "", 0
        for s in row.found:
            if s.start >= at:
                want += text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
            seen.add(s.kind)
        new = got[row.doc_id]
        assert (new.text or "") == want + text[at:] and new.found == "x"
        assert (new.text is None) == (made[row.doc_id] is None) and new.n_chars == (None if new.text is None else len(new.text))
    assert seen == {k.name for k in pii.KINDS}
    assert pii.mask_found(docs.limit(0)).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.pii_digest(docs).count() == 0 and pii.mask_found(docs).count() == 0 and sharding.shard(docs).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(None, None), (None, None), (7, "text 7 é"), (8, "")]
    docs = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, shard int, slot int").repartition(5)
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    slots = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, sharding.SHARDS) and 0 <= r.shard < sharding.SHARDS and r.law == "key"
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    moved = sum(r.grown_shard == sharding.SHARDS for r in got)
    assert 0.4 * len(rows) / 25 < moved < 1.8 * len(rows) / 25
    assert sharding.shard(docs.repartition(2)).exceptAll(sharding.shard(docs)).count() == 0


def test_weights(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.shard(docs, weights=(1.0, 3.0)).groupBy("shard").count().collect()}
    assert 2.6 < counts[1] / counts[0] < 3.4


def plain_hash(key, *parts):
    """Spark's xxhash64 of a text and numbers, each hash the seed of the next, as 52 bits."""
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h >> 12


def plain_winner(key, weights):
    def cost(s):
        return -math.log((plain_hash(key, struct.pack("<i", s)) + 0.5) / 2**52) / weights[s]

    return min(range(len(weights)), key=cost)


def test_shards_and_slots_against_plain_draws(spark):
    rows = [(i, "x" * (i % 7)) for i in range(-20, 280)] + [(None, None), (5, "copy"), (5, "copy"), (2**63 - 1, "é")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (1.0, 2.5, 0.5), 1.5).collect()
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        key, raw = "null" if i is None else str(i), (text or "").encode()
        crc = zlib.crc32(raw)
        own, grown = plain_winner(key, (1.0, 2.5, 0.5)), plain_winner(key, (1.0, 2.5, 0.5, 1.5))
        want.append((own, plain_hash(key, struct.pack("<q", crc)), i is not None, i or 0, len(raw) + 8, crc, grown))
    place = {}
    slots = [(shard, place.setdefault(shard, []).append(0) or len(place[shard]) - 1, i if known else None, size, crc, grown)
             for shard, _, known, i, size, crc, grown in sorted(want)]
    assert sorted(slots) == sorted((r.shard, r.slot, r.doc_id, r.size, r.text_crc32, r.grown_shard) for r in got)
