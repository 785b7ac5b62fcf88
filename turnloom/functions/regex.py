"""Pattern helpers: ASCII word boundaries and Unicode white space on the JVM.

Patterns are written once in the common dialect (``\\b`` ASCII, ``\\s`` Unicode);
``java`` turns them into the form Java 17 needs, DuckDB takes them as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one, for functions that take characters instead of a pattern.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = "[^" + SPACE[1:]
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


_START = r"(?<!\w)"
_END = r"(?!\w)"


def java(pattern: str) -> str:
    """ASCII ``\\b`` and Unicode ``\\s`` for Java; ``\\b`` right before a word character gets the short form."""
    out = pattern.replace(r"[\s\S]", r"[\x{0}-\x{10ffff}]")
    out = re.sub(r"\\b(?=[A-Za-z0-9]|\\d)", lambda _: _START, out)
    return out.replace(r"\b", _EDGE).replace(r"\s", SPACE)


@dataclass(frozen=True)
class Rule:
    """A named test on lower-cased text.

    ``pattern`` is the whole rule. ``phrases`` are its literal whole-word alternatives, ``extra``
    the remaining ones, each with literal stems that must occur for it to match.
    """

    pattern: str
    phrases: tuple[str, ...] = ()
    extra: tuple[tuple[str, tuple[str, ...]], ...] = ()
    words: bool = False  # every alternative starts and ends with a word character

    @property
    def jvm(self) -> str:
        if self.words:
            return _START + java(self.pattern[2:-2]) + _END
        return java(self.pattern)

    def test(self, text: Column) -> Column:
        """The rule on its own, as one regex."""
        return text.rlike(self.jvm)

    def extra_tests(self, low: str) -> list[str]:
        """Tests, as SQL text, for the alternatives that are not literal phrases."""
        from turnloom.functions.sqltext import contains_any, matches

        return [
            f"({contains_any(low, stems)} AND {matches(low, pattern)})" if stems else matches(low, pattern)
            for pattern, stems in self.extra
        ]

    def matches(self, low: str) -> str:
        """Number of non-overlapping matches, as SQL text."""
        from turnloom.functions.sqltext import q

        return f"regexp_count({low}, {q(self.jvm)})"


def _word_trie(phrases, end: str) -> str:
    """One alternation for all phrases, shared prefixes factored out, longer phrases first."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        letters = sorted(ch for ch in node if ch)
        if len(letters) > 6:
            # a character class in front of every few branches rules most of them out at once
            options = []
            for i in range(0, len(letters), 5):
                some = letters[i : i + 5]
                inner = "|".join(re.escape(ch) + render(node[ch]) for ch in some)
                options.append("(?=[" + "".join(map(re.escape, some)) + "])(?:" + inner + ")")
        else:
            options = [re.escape(ch) + render(node[ch]) for ch in letters]
        if "" in node:
            options.append(end)
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    return render(root)


class PhraseScan:
    """One pass over a text that reports which whole-word phrases of a vocabulary start where.

    At every start the longest phrase is reported; a shorter one that starts at the same place is
    one of its prefixes, so a rule is met by its own phrases and by their longer relatives.
    """

    def __init__(self, phrases):
        self.phrases = sorted(set(phrases))

    def hits(self, low: str) -> str:
        """1-based phrase numbers found in the text, without repeats, as SQL text."""
        from turnloom.functions.sqltext import q, string_array

        if not self.phrases:
            return "CAST(array() AS ARRAY<BIGINT>)"
        pattern = f"{_START}(?=({_word_trie(self.phrases, _END)}))"
        found = f"array_distinct(regexp_extract_all({low}, {q(pattern)}, 1))"
        # constant arrays are written as folded text: two plan nodes instead of hundreds
        return f"transform({found}, h -> array_position({string_array(self.phrases)}, h))"

    def _met_by(self, phrase: str, wanted) -> bool:
        def continues(w: str) -> bool:
            rest = phrase[len(w):]
            return phrase.startswith(w) and (not rest or not re.match(r"\w", rest, re.ASCII))

        return any(continues(w) for w in wanted)

    def rule_bits(self, hits: str, rules: list[tuple[int, "Rule"]]) -> str:
        """OR over the found phrases of the bits of the rules each one meets."""
        masks = [sum(1 << bit for bit, rule in rules if self._met_by(p, rule.phrases)) for p in self.phrases]
        if not any(masks):
            return "0L"
        table = f"CAST(split('{','.join(map(str, masks))}', ',') AS ARRAY<BIGINT>)"
        return f"aggregate({hits}, 0L, (acc, i) -> acc | element_at({table}, CAST(i AS INT)))"


def _literal_forms(fragment: str) -> list[str] | None:
    """The literal strings a fragment stands for: plain, with an optional last letter or an optional ending."""
    if m := re.fullmatch(r"([a-z0-9 ';-]+)\(\?:([a-z]+)\)\?", fragment):
        return [m[1], m[1] + m[2]]
    if m := re.fullmatch(r"([a-z0-9 ';-]+)([a-z])\?", fragment):
        return [m[1], m[1] + m[2]]
    plain = fragment.replace(r"\.", ".")
    return [plain] if re.fullmatch(r"[a-z0-9](?:[a-z0-9 .';-]*[a-z0-9])?", plain) else None


def terms(*fragments: str) -> Rule:
    """Whole-word alternation of lower-case fragments."""
    phrases, extra = [], []
    for f in fragments:
        forms = _literal_forms(f)
        if forms:
            phrases += forms
        else:
            extra.append((r"\b(?:" + f + r")\b", (re.match(r"[a-z ]*", f).group(),)))
    pattern = r"\b(" + "|".join(fragments) + r")\b"
    return Rule(pattern, tuple(dict.fromkeys(phrases)), tuple(extra), not extra)


def raw(pattern: str, *extra: tuple[str, tuple[str, ...]], phrases: tuple[str, ...] = ()) -> Rule:
    """A rule given as a pattern; ``extra`` and ``phrases`` together must cover its alternatives."""
    return Rule(pattern, phrases, extra or ((() if phrases else ((pattern, ()),))))
