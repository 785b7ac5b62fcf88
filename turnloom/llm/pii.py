"""Personal data: patterns propose, checksums confirm, nearby words move the score. SQL functions alone.

The patterns are the base patterns in a form that the JVM's engine matches in linear time and without recursion: they start
at the end of the last match or after a character that could not belong to the match, and they repeat single characters only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WINDOW = 40  # characters on either side in which a context word counts
THRESHOLD = 0.5  # score from which a span of an added kind is kept
NEAR = 0.3  # what a context word adds
BLOCK = 512  # matches whose lengths are summed at a time
CHUNK = 512  # characters that are cut out of at a time
BASE_KINDS = ("email", "ip", "card", "phone")
#: Published lengths of account numbers by country; IBAN_OTHERS are in use without being registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_OTHERS = {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}


def _iban() -> str:
    """Account numbers of the length of their country; those of other codes take in what follows, up to a known beginning."""
    by_length = [(n, codes) for table in (IBAN_LENGTHS, IBAN_OTHERS) for n, codes in table.items()]
    known = "|".join(codes.replace(" ", "|") for _, codes in by_length)

    def of_length(n: int, codes: str) -> str:
        groups, rest = divmod(n - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        return rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}"

    following = rf"(?:\x20(?!(?:{known})[0-9]{{2}}))?"
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:{following}[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(of_length(*x) for x in by_length)}|{other})(?![A-Za-z0-9])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits that pass Luhn's test."""
    plain = F.reverse(digits(value))
    n = F.length(plain)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(plain, i, F.lit(1)).cast("int")
        double = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(double > 9, double - 9).otherwise(double)

    ok = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
    return F.when(n.between(12, 19), ok).otherwise(False)


def mod97(value: Column) -> Column:
    """An account number of 15 to 34 characters whose rearranged digits leave 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    ok = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1
    return F.when(F.length(plain).between(15, 34), ok).otherwise(False)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a pattern without which no match is possible
    words: str  # context words, a pattern
    score: float
    confirm: Callable[[Column], Column] = lambda value: F.lit(True)
    base: bool = True


KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.{LABEL}[A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)",
        "@", "(?i)e-?mail|contact|write|address|courriel|correo|kontakt", 0.9,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"(?i)\bip\b|host|server|login|addr", 0.6,
        lambda value: value.rlike(rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"),
    ),
    Kind(
        "card", r"[0-9](?=[ -]?[0-9])[0-9 -]*?[0-9](?=[ -][ -]|[ -]?(?:[^0-9 -]|\z))", "[0-9]",
        "(?i)card|visa|credit|payment|carte|karte|tarjeta", 0.7, luhn,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)phone|call|tel|mobile|fax", 0.6,
        lambda value: F.length(digits(value)).between(9, 15),
    ),
    Kind(
        "iban", _iban(), "[A-Z]{2}[0-9]{2}",
        "(?i)iban|account|bank|konto|compte|cuenta", 0.8, mod97, base=False,
    ),
    Kind(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
        r"(?i)\bssn\b|social security|insurance number", 0.3, base=False,
    ),
)


def _lengths(kind: Kind) -> Column:
    hits, gaps = F.col(f"hits_{kind.name}"), F.col(f"gaps_{kind.name}")
    return F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: (F.length(h) + F.length(g)).cast("bigint"))


def _running(lengths: Column) -> Column:
    """Running sums of an array of longs, by blocks, so that the copying of partial arrays stays linear."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    none = F.array().cast("array<bigint>")

    def push(done: Column, add: Column) -> Column:
        return F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")) + add))

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda t, x: t + x))
    ends = F.aggregate(totals, none, push)
    sums = F.transform(blocks, lambda b: F.aggregate(b, none, push))
    shifted = F.zip_with(F.arrays_zip(sums.alias("s"), totals.alias("t")), ends, lambda b, e: F.transform(b["s"], lambda x: x + e - b["t"]))
    return F.when(n > 0, F.flatten(shifted)).otherwise(none)


def _proposals(docs: DataFrame) -> DataFrame:
    """Adds hits_<kind> and gaps_<kind>: the matches, and the text before, between and after them."""
    none = F.array().cast("array<string>")
    out = [F.col(c) for c in docs.columns]
    for kind in KINDS:
        there = F.col("text").rlike(kind.hint)
        out.append(F.when(there, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))).otherwise(none).alias(f"hits_{kind.name}"))
        out.append(F.when(there, F.split("text", kind.pattern, -1)).otherwise(none).alias(f"gaps_{kind.name}"))
    return docs.select(*out)


def _spans(kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind: (start, rank, end, kind, score)."""
    hits, gaps, ends = (F.col(f"{x}_{kind.name}") for x in ("hits", "gaps", "ends"))
    near = F.zip_with(
        hits, F.sequence(F.lit(1), F.size(hits)),
        lambda h, i: F.concat(F.right(F.get(gaps, i - 1), F.lit(WINDOW)), F.lit("\n"), F.left(F.get(gaps, i), F.lit(WINDOW))),
    )
    rows = F.zip_with(F.arrays_zip(hits.alias("h"), ends.alias("e")), near, lambda m, around: F.struct(m["h"].alias("value"), m["e"].alias("end"), around.alias("near")))
    rows = F.filter(rows, lambda r: kind.confirm(r["value"]))
    spans = F.transform(
        rows,
        lambda r: F.struct(
            (r["end"] - F.length(r["value"])).cast("long").alias("start"),
            F.lit(rank).alias("rank"),
            r["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.score) + F.when(r["near"].rlike(kind.words), NEAR).otherwise(0.0)).alias("score"),
        ),
    )
    spans = spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and found: the spans (start, rank, end, kind, score) of every row, by start and kind.

    Offsets are code points, the end exclusive. A null text is empty; repeated rows are kept. Spans of the kinds email, ip,
    card and phone stay whatever their score; spans of the added kinds need THRESHOLD.
    """
    proposed = _proposals(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    for prepare in (_lengths, lambda kind: _running(F.col(f"ends_{kind.name}"))):
        proposed = proposed.withColumns({f"ends_{kind.name}": prepare(kind) for kind in KINDS})
    found = F.array_sort(F.concat(*(_spans(kind, rank) for rank, kind in enumerate(KINDS))))
    return proposed.select("doc_id", "text", found.alias("found"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and written spans of `find_pii`, a row for each row of docs."""
    found = find_pii(docs, id_col, text_col).select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def _reach(ends: Column) -> Column:
    """The greatest end before each span, by blocks like `_running`."""
    n = F.size(ends)
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(ends, b * BLOCK + 1, BLOCK))

    def push(done: Column, end: Column) -> Column:
        return F.concat(done, F.array(F.greatest(F.element_at(done, -1), end)))

    tops = F.aggregate(F.transform(blocks, F.array_max), F.array(zero), push)
    inner = F.zip_with(blocks, F.slice(tops, F.lit(1), F.size(blocks)), lambda b, top: F.slice(F.aggregate(b, F.array(top), push), F.lit(1), F.size(b)))
    return F.when(n > 0, F.flatten(inner)).otherwise(none)


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, cut out of chunks of CHUNK characters."""
    first, last = (F.floor(at / CHUNK).cast("int") for at in (start, end))
    skip, rest = ((at % CHUNK).cast("int") for at in (start, end))
    head = F.coalesce(F.get(chunks, first), F.lit(""))
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.substr(F.get(chunks, last), F.lit(1), rest), F.lit(""))
    return F.when(first == last, F.substr(head, skip + 1, rest - skip)).otherwise(F.concat(F.substr(head, skip + 1), whole, tail))


def mask_found(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of `find_pii` replaced by its kind in brackets, and nothing else.

    Spans that overlap are replaced together, by the kind that begins first. A null text stays null; chars_col, if there,
    follows the new text.
    """
    found = find_pii(docs.select(F.struct(*docs.columns).alias("doc_id"), F.col(text_col).alias("text")))
    spans = F.col("found")
    chunks = F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    out = found.withColumn("chunks", chunks).withColumn("reach", _reach(F.transform(spans, lambda s: s["end"])))
    text = F.col("doc_id")[text_col]

    def piece(span: Column, before: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.when(span["start"] >= before, F.concat(_between(F.col("chunks"), before, span["start"]), mark)).otherwise("")

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    new = F.concat(F.array_join(F.zip_with("found", "reach", piece), ""), _between(F.col("chunks"), end, F.length("text").cast("bigint")))
    out = out.withColumn("new", F.when(F.size(spans) > 0, new).otherwise(text.cast("string")))
    changed = {text_col: F.col("new")}
    if chars_col and chars_col in docs.columns:
        changed[chars_col] = F.length("new").cast("long")
    return out.select(*(changed.get(c, F.col("doc_id")[c]).alias(c) for c in docs.columns))
