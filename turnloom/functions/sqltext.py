"""Expressions as Spark SQL text: one call to the JVM per expression instead of one per node."""

from __future__ import annotations

from turnloom.functions.regex import SPACES, java


def q(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def either(conditions) -> str:
    items = list(conditions)
    return "(" + " OR ".join(items) + ")" if items else "false"


def contains_any(text: str, words) -> str:
    return either(f"contains({text}, {q(w)})" for w in words)


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {q(java(pattern))})"


def find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(java(pattern))}, {group})"


def count_all(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {q(java(pattern))})"


def by_domain(domain: str, branches: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN {domain} = {q(name)} THEN {value}" for name, value in branches.items())
    return f"CASE {cases} ELSE {default} END" if branches else default


def points(condition: str, n: int) -> str:
    return f"IF({condition}, {n}, 0)"


def pack(conditions: list[str]) -> str:
    """Booleans to one long, first one in the lowest bit."""
    if len(conditions) > 62:
        raise ValueError("more flags than bits in a long")
    return "(" + " + ".join(f"CAST({c} AS BIGINT) * {1 << i}L" for i, c in enumerate(conditions)) + ")" if conditions else "0L"


def ws_trim(text: str) -> str:
    return f"btrim({text}, {q(SPACES)})"


def string_array(values) -> str:
    """A constant string array, folded from text."""
    return f"split({q(chr(10).join(values))}, {q(chr(10))})"


def strings(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"
