"""Text column functions: cleaning, tokens, slugs, titles, lead sentences, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.regex import SPACE, SPACES, java


def ws_trim(c: Column) -> Column:
    """Trim any Unicode white space at both ends (Spark's trim only strips blanks)."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def compact(c: Column, limit: int = 90) -> Column:
    """Collapse white space, trim, cut."""
    return F.substring(F.trim(collapse(c)), 1, limit)


def compact_sentence(c: Column, limit: int) -> Column:
    """As compact, with pipe characters dropped before the cut."""
    return F.substring(F.regexp_replace(F.trim(collapse(c)), r"[|]", ""), 1, limit)


def tokenize(c: Column) -> Column:
    """Lower-case words of four or more characters that start with a letter."""
    return F.regexp_extract_all(F.lower(c), F.lit(java(r"\b[a-z][a-z0-9-]{3,}\b")), F.lit(0))


def slug(c: Column, default: str = "untitled") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"\A-|-\z", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def title_case(c: Column) -> Column:
    """Dashes to blanks, then upper-case the first character of each ASCII word; the rest is unchanged."""
    s = F.trim(collapse(F.regexp_replace(c, r"[-_]+", " ")))
    # split at ASCII word starts, so every later piece begins with a word character
    parts = F.split(s, r"(?<!\w)(?=\w)")

    def upper_first(p: Column) -> Column:
        return F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A[a-z]"), upper_first(p)).otherwise(p)), "")


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _collapsed_head(c: Column, chars: int) -> Column:
    """collapse(c), or a beginning of it with more than ``chars`` characters, made from the beginning of the text."""
    part = chars + chars // 4
    enough = F.length(c) <= part
    return _let(collapse(F.substring(c, 1, part)), lambda h: F.when(enough | (F.length(h) > chars + 1), h).otherwise(collapse(c)))


def lead_sentences(c: Column, n: int, chars: int) -> Column:
    """The first n sentences, cut to ``chars``; the text's own head when there is none."""
    pieces = F.split(_collapsed_head(c, chars), "(?<=[.!?]) ")  # white space is single blanks there
    head = F.substring(F.array_join(F.slice(F.filter(pieces, lambda p: p != ""), 1, n), " "), 1, chars)
    return _let(head, lambda h: F.when(h == "", F.substring(c, 1, chars)).otherwise(h))


def _named_phrases(c: Column) -> Column:
    return F.regexp_extract_all(
        c, F.lit(java(r"\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3}\b")), F.lit(0)
    )


CONCEPT_HEAD = 1000  # characters that are looked at first
CONCEPT_WORDS = 32  # candidates that are cased first


def concepts(content: Column, title: Column | None = None, limit: int | None = 8) -> Column:
    """Title, capitalised phrases and long words, title-cased, unique in order of appearance.

    With a limit, candidates are found and cased only as far as it takes. What a beginning of the text gives is what the whole
    text begins with, but for the last match, which may go on behind the cut.
    """

    def listed(phrases: Column, words: Column | None = None) -> Column:
        parts = [phrases] if words is None else [phrases, F.filter(words, lambda t: F.length(t) > 6)]
        if title is not None:
            parts.insert(0, F.array(title))
        # equal raw candidates have equal titles, so dropping repeats first saves the casing work
        return F.array_distinct(F.concat(*parts))

    def unique(raw: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(raw, title_case), lambda t: F.length(t) > 2))

    def found(c: Column) -> Column:
        return listed(_named_phrases(c), tokenize(c))

    if not limit:
        return unique(found(content))
    head = F.substring(content, 1, CONCEPT_HEAD)

    def certain(matches: Column) -> Column:
        return _let(matches, lambda m: F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))))

    def enough(some: Column, otherwise: Column) -> Column:
        return _let(unique(some), lambda u: F.when(F.size(u) >= limit, F.slice(u, 1, limit)).otherwise(otherwise))

    whole = _let(found(content), lambda raw: enough(F.slice(raw, 1, CONCEPT_WORDS), F.slice(unique(raw), 1, limit)))
    with_words = enough(F.slice(listed(_named_phrases(content), certain(tokenize(head))), 1, CONCEPT_WORDS), whole)
    return F.when(F.length(content) <= CONCEPT_HEAD, whole).otherwise(enough(listed(certain(_named_phrases(head))), with_words))


def est_tokens(chars: Column) -> Column:
    """Tokens for a total number of characters: sum first, then a quarter rounded up."""
    return F.ceil(chars / F.lit(4)).cast("long")


def est_tokens_log(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4.1)).cast("long")


def saved_tokens(original: Column, compressed: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), original - compressed)


def savings_pct(original: Column, compressed: Column, decimals: int = 1) -> Column:
    """Percent saved, rounded half up; 0 for an empty original."""
    pct = F.round(saved_tokens(original, compressed) / original * 100, decimals)
    return F.when(original > 0, pct).otherwise(F.lit(0.0))


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def account_id(c: Column) -> Column:
    """Mixed-case identifier, at most 128 characters."""
    return F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9._:@-]", "-"), 1, 128)


def namespace_id(c: Column, default: str = "default") -> Column:
    """Lower-case memory namespace, at most 80 characters, with a default for empty input."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_.-]+", "-"), r"\A-|-\z", "")
    s = F.substring(s, 1, 80)
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def strip_images(c: Column) -> Column:
    """Replace inline base64 images by a marker."""
    return F.regexp_replace(
        c, r"data:image/[a-zA-Z]*;base64,[A-Za-z0-9+/=]+", "[BASE64_IMAGE_REMOVED]"
    )


def shorten_long_lines(c: Column, limit: int = 300, head: int = 150, tail: int = 50) -> Column:
    """Lines over the limit keep their head and tail around a marker."""

    def one(line: Column) -> Column:
        n = F.length(line)
        short = F.concat(
            F.substring(line, 1, head),
            F.lit(" ... [LONG LINE OF "),
            n.cast("string"),
            F.lit(" CHARS TRUNCATED] ... "),
            F.substring(line, -tail, tail),
        )
        return F.when(n > limit, short).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n", -1), one), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def distinct_by_lower(items: str) -> str:
    """First occurrence per lower-cased value, in order, as SQL text; one sort, no pairwise comparison."""
    keyed = f"array_sort(transform({items}, (x, i) -> struct(lower(x) AS k, i AS i, x AS v)))"
    # a lambda over a one-element array evaluates the sorted list once
    first = f"transform(array({keyed}), s -> filter(s, (x, i) -> i = 0 OR get(s, i - 1).k <> x.k))[0]"
    return f"transform(array_sort(transform({first}, x -> struct(x.i AS i, x.v AS v))), x -> x.v)"
