"""How much a turn matters for the current request: domain words, known facts, structure, actions, small talk.

Functions take SQL text and return SQL text, so that the same expression serves rows and array elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.sqltext import by_domain, contains_any, count_all, matches, points, q
from turnloom.functions.vocab import DEFAULT, OTHER_DOMAIN_PATTERN, Vocabulary


def is_distractor(low: str, vocab: Vocabulary = DEFAULT) -> str:
    words = "|".join(vocab.distractors)
    pattern = q(rf"(?<!\w)(?:{words})(?!\w)")
    return f"({contains_any(low, vocab.distractors)} AND rlike({low}, {pattern}))"


def drop_distractors(turns: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return turns.filter(F.expr(f"NOT {is_distractor('lower(text)', vocab)}"))


def domain_count(text: str, domain: str, vocab: Vocabulary = DEFAULT) -> str:
    """Matches of the domain's pattern, case-insensitive; words for an unknown domain."""
    found = {name: count_all(text, "(?i)" + pattern) for name, pattern in vocab.domain_patterns.items()}
    return by_domain(domain, found, count_all(text, OTHER_DOMAIN_PATTERN))


def structure_boost(text: str, domain: str, vocab: Vocabulary = DEFAULT) -> str:
    return by_domain(domain, {d: points(matches(text, p), n) for d, (p, n) in vocab.structure_boosts.items()}, "0")


def action_boost(low: str, domain: str, vocab: Vocabulary = DEFAULT) -> str:
    boosts = {d: points(f"rlike({low}, {q(rule.jvm)})", n) for d, (rule, n) in vocab.action_boosts.items()}
    return by_domain(domain, boosts, "0")


def distractor_points(low: str, vocab: Vocabulary = DEFAULT) -> str:
    """Points for off-topic phrases, before any reduction."""

    def word(w: str) -> str:
        pattern = q(rf"(?<!\w){w}(?!\w)")
        return points(f"contains({low}, {q(w)}) AND rlike({low}, {pattern})", 3)

    extra = [points(matches(low, p), n) for p, n in vocab.extra_distractors]
    return "(" + " + ".join([word(w) for w in vocab.distractors] + extra) + ")"


def distractor_penalty(low: str, raw_points: str, domain_score: str, vocab: Vocabulary = DEFAULT) -> str:
    """Three reductions of the points in this order, none below zero."""
    on_topic = f"rlike({low}, {q(vocab.on_topic.jvm)})"
    fetching = f"contains({low}, 'requests') AND contains({low}, 'python')"
    first = f"greatest(0, {raw_points} - {points(f'{domain_score} > 0', 2)})"
    second = f"greatest(0, {first} - {points(on_topic, 3)})"
    third = f"greatest(0, {second} - {points(fetching, 2)})"
    return f"IF({raw_points} > 0, {third}, 0)"


def base_score(text: str, low: str, domain_score: str, raw_points: str, domain: str, vocab: Vocabulary = DEFAULT) -> str:
    """Relevance without known facts."""
    penalty = distractor_penalty(low, raw_points, domain_score, vocab)
    return (
        f"({domain_score} + {structure_boost(text, domain, vocab)} + {action_boost(low, domain, vocab)} - {penalty})"
    )


def scored_turns(rows: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add ``low``, ``domain_score``, ``off_topic`` and ``base_score`` to rows with text and domain."""
    rows = rows.withColumn("low", F.lower("text"))
    rows = rows.withColumns(
        {
            "domain_score": F.expr(domain_count("text", "domain", vocab)),
            "off_topic": F.expr(distractor_points("low", vocab)),
        }
    )
    return rows.withColumn("base_score", F.expr(base_score("text", "low", "domain_score", "off_topic", "domain", vocab)))


def scored_messages(messages: str, domain: str, vocab: Vocabulary = DEFAULT) -> str:
    """The same over a bounded message array: (pos, role, text, low, base)."""
    prepared = (
        f"transform({messages}, (m, i) -> struct(CAST(i AS BIGINT) AS pos, m.role AS role, m.text AS text, "
        f"lower(m.text) AS low, {domain_count('m.text', domain, vocab)} AS found))"
    )
    pointed = (
        f"transform({prepared}, m -> struct(m.pos AS pos, m.role AS role, m.text AS text, m.low AS low, "
        f"m.found AS found, {distractor_points('m.low', vocab)} AS off))"
    )
    base = base_score("m.text", "m.low", "m.found", "m.off", domain, vocab)
    return (
        f"transform({pointed}, m -> struct(m.pos AS pos, m.role AS role, m.text AS text, m.low AS low, {base} AS base))"
    )
