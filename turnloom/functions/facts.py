"""Fact, constraint and open-question extraction over one text. Arguments are SQL text; what says so returns SQL text, the rest columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.sqltext import NO_STRINGS, by_domain, find_all, matches, points, q, strings, ws_trim
from turnloom.functions.text import compact_sentence, distinct_by_lower
from turnloom.functions.vocab import (
    CONSTRAINT_PATTERNS,
    DEFAULT,
    DOMAIN_CONSTRAINTS,
    HIGH_VALUE_DOMAINS,
    IMPORTANT_FACTS,
    UNRESOLVED_PATTERNS,
    Vocabulary,
)


def ordered_distinct(items: str) -> str:
    """Trimmed, unquoted, 2 to 160 characters, first occurrence per lower-cased value."""
    quotes = q(r"\A['\"]|['\"]\z")
    bare = f"transform({items}, x -> regexp_replace({ws_trim('x')}, {quotes}, ''))"
    return distinct_by_lower(f"filter({bare}, x -> length(x) BETWEEN 2 AND 160)")


def _code_blocks(text: str) -> str:
    """Fenced blocks, cut to 160 characters; ones of 12 characters or less are dropped."""
    blocks = find_all(text, r"```[\s\S]*?```")
    cut = f"transform({blocks}, b -> substring({ws_trim('b')}, 1, 160))"
    return f"filter({cut}, b -> length(b) > 12)"


def _collect(text: str, patterns) -> str:
    return strings([_code_blocks(text) if p == "CODE_BLOCK" else find_all(text, p) for p in patterns])


def extract_facts(text: str, domain: str, vocab: Vocabulary = DEFAULT) -> Column:
    """Facts in collection order: the domain's patterns one after the other, then the common ones."""
    own = by_domain(domain, {d: _collect(text, p) for d, p in vocab.fact_patterns.items()}, NO_STRINGS)
    return F.expr(ordered_distinct(strings([own, _collect(text, vocab.common_facts)])))


def fact_importance(fact: str, domain: str) -> str:
    known = by_domain(domain, {d: points(matches(fact, p), 4) for d, p in IMPORTANT_FACTS.items()}, "0")
    marked, digit = points(f"rlike({fact}, '[#/]')", 3), points(f"rlike({fact}, '[0-9]')", 2)
    return f"({marked} + {digit} + {points(f'contains({fact}, {q(chr(32))})', 1)} + {known})"


def rank_facts(facts: str, domain: str, n: int) -> Column:
    """The first n facts: most important first, then shorter, then earlier."""
    entry = f"struct(-{fact_importance('f', domain)} AS s, length(f) AS n, i AS i, f AS fact)"
    return F.expr(f"slice(transform(array_sort(transform({facts}, (f, i) -> {entry})), e -> e.fact), 1, {n})")


def infer_constraints(text: str, domain: str, limit: int = 4) -> Column:
    own = by_domain(domain, {d: find_all(text, p) for d, p in DOMAIN_CONSTRAINTS.items()}, NO_STRINGS)
    found = strings([_collect(text, CONSTRAINT_PATTERNS), own])
    return F.expr(f"slice({ordered_distinct(found)}, 1, {limit})")


def infer_unresolved(text: str, domain: str, intent: str, limit: int = 4) -> Column:
    def guarded(name: str, guard: str | None, items: str) -> str:
        found = find_all(text, items)
        if guard is None:
            return found
        ok = matches(f"lower({text})", guard)
        if name == "education":
            ok = f"({ok} OR {intent} = 'summarization')"
        return f"IF({ok}, {found}, {NO_STRINGS})"

    branches = {d: guarded(d, g, p) for d, (g, p) in UNRESOLVED_PATTERNS.items()}
    return F.expr(f"slice({ordered_distinct(by_domain(domain, branches, NO_STRINGS))}, 1, {limit})")


def user_goal(latest: Column, domain: Column, intent: Column) -> Column:
    prefix = (
        F.when(intent == "debugging", F.lit("Resolve "))
        .when(intent == "generation", F.lit("Produce "))
        .when(domain == "customer_support", F.lit("Support request: "))
        .when(domain == "sales", F.lit("Advance the sales conversation: "))
        .otherwise(F.lit(""))
    )
    return F.when(latest != "", compact_sentence(F.concat(prefix, latest), 96))


def high_value(domain: Column) -> Column:
    return domain.isin(*HIGH_VALUE_DOMAINS)


def entity_budget(domain: Column, intent: Column) -> Column:
    return (
        F.when((domain == "coding") & (intent == "generation"), F.lit(8))
        .when(domain.isin("legal", "medical", "commerce", "general"), F.lit(7))
        .when(high_value(domain), F.lit(6))
        .otherwise(F.lit(5))
    )


def contained_count(facts: str, low_text: str) -> str:
    """How many facts (already lower-cased) of at least three characters occur in the text."""
    return f"size(filter({facts}, f -> length(f) >= 3 AND contains({low_text}, f)))"


def missing_from(facts: str, low_text: str) -> str:
    """Facts whose lower-cased form does not occur in the text."""
    return f"transform(array({low_text}), t -> filter({facts}, f -> NOT contains(t, lower(f))))[0]"


def drop_subsumed(facts: str, limit: int = 12) -> str:
    """Drop a fact when an earlier kept, different fact contains it; order matters."""
    covered = "exists(kept, o -> contains(lower(o), lower(f)) AND o <> f)"
    step = f"IF({covered}, kept, concat(kept, array(f)))"
    return f"slice(aggregate({facts}, {NO_STRINGS}, (kept, f) -> {step}), 1, {limit})"
