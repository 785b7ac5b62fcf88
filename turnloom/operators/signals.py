"""Per-turn signals packed into one small array, so that only numbers travel through the shuffle.

Every context rule is an alternation of phrases without line breaks, and a context is turns
joined by line breaks. So a test on the context is the OR of the tests on its turns, and a count
is the sum of the counts. Each turn is scanned once; windows lift the results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.regex import PhraseScan, Rule
from turnloom.functions.sqltext import contains_any, pack, string_array
from turnloom.functions.vocab import SCORED_DOMAINS, Vocabulary

WORD_BITS = 60
LOOKBACK_RISK = 6
LOOKBACK_URGENCY = 4
LOOKBACK_TOPIC = 2


@dataclass(frozen=True)
class Layout:
    """Where each rule sits in the packed array for a given vocabulary and plugin list."""

    vocab: Vocabulary
    plugins: tuple = ()

    @cached_property
    def keywords(self) -> list[tuple[str, str]]:
        return [(g, w) for g, words in self.vocab.keyword_groups.items() for w in words]

    @cached_property
    def near_words(self) -> list[tuple[str, str]]:
        groups = self.vocab.keyword_groups
        return [(g, w) for g in ("crisis", "unsafe", "urgency") for w in groups.get(g, [])]

    @property
    def keyword_longs(self) -> int:
        return max(1, -(-len(self.keywords) // WORD_BITS))

    @property
    def plugin_longs(self) -> int:
        return -(-len(self.plugins) // WORD_BITS)

    # slots of the packed array, 0-based
    CONTEXT, CURRENT, NEAR = 0, 1, 2

    @property
    def keyword_slot(self) -> int:
        return 3

    @property
    def plugin_slot(self) -> int:
        return 3 + self.keyword_longs

    @property
    def score_slot(self) -> int:
        return self.plugin_slot + self.plugin_longs

    @property
    def chars_slot(self) -> int:
        return self.score_slot + len(SCORED_DOMAINS)

    @property
    def size(self) -> int:
        return self.chars_slot + 1

    @cached_property
    def context_names(self) -> list[str]:
        return list(self.vocab.context)

    @cached_property
    def current_names(self) -> list[str]:
        return ["is_user", "frustrated", "positive", *self.vocab.structures, *self.vocab.current]

    def near_bit(self, group: str, word: str) -> int:
        return self.near_words.index((group, word))

    @property
    def distress_bit(self) -> int:
        return len(self.near_words)

    @property
    def small_talk_bit(self) -> int:
        return len(self.near_words) + 1

    def near_mask(self, group: str) -> int:
        return sum(1 << i for i, (g, _) in enumerate(self.near_words) if g == group)

    @cached_property
    def phrase_scan(self) -> PhraseScan:
        v = self.vocab
        rules = [*v.context.values(), *v.current.values(), *v.structures.values(), *v.scores.values(), v.small_talk]
        return PhraseScan([p for r in rules for p in r.phrases])

    def features(self, rows: DataFrame, text: str = "text", role: str = "role", keep: tuple = ()) -> DataFrame:
        """Add the packed array ``feat``: one phrase scan per turn plus substring tests for the keywords."""
        lowered = rows.select(
            *keep, F.lower(text).alias("_low"), F.length(text).alias("_chars"), F.col(role).alias("_role")
        )
        scanned = lowered.select("*", F.expr(self.phrase_scan.hits("_low")).alias("_hits"))
        return scanned.select(*keep, self._packed().alias("feat"))

    def _packed(self) -> Column:
        """The array over the columns _low, _hits, _role and _chars."""
        v = self.vocab

        def rule_word(rules: list[tuple[int, Rule]]) -> str:
            """Bits of all rules at once: found phrases by table, the other alternatives one by one."""
            bits = self.phrase_scan.rule_bits("_hits", rules)
            others = [
                f"IF({test}, {1 << bit}L, 0L)" for bit, rule in rules for test in rule.extra_tests("_low")
            ]
            return " | ".join([bits, *others])

        def any_part(words) -> str:
            return contains_any("_low", words)

        named = {**v.structures, **v.current}
        plain = ["_role = 'user'", any_part(v.affect_words["frustrated"]), any_part(v.affect_words["positive"])]
        context = rule_word(list(enumerate(v.context.values())))
        current = pack(plain) + " | " + rule_word([(i + len(plain), r) for i, r in enumerate(named.values())])
        near_parts = [any_part([w]) for _, w in self.near_words] + [any_part(v.affect_words["distressed"])]
        near = pack(near_parts) + " | " + rule_word([(self.small_talk_bit, v.small_talk)])
        in_turn = [any_part([w]) for _, w in self.keywords]
        plugged = [any_part([k.lower() for k in p["keywords"]]) for p in self.plugins]
        keyword = [pack(in_turn[i : i + WORD_BITS]) for i in range(0, len(in_turn), WORD_BITS)] or ["0L"]
        plugin = [pack(plugged[i : i + WORD_BITS]) for i in range(0, len(plugged), WORD_BITS)]
        parts = [context, current, near, *keyword, *plugin, *self._scores(rule_word), "CAST(_chars AS BIGINT)"]
        return F.expr(f"array({', '.join(parts)})")

    def _scores(self, rule_word) -> list[str]:
        """Match counts per domain; the counting regex runs only on turns that can match."""
        v = self.vocab
        possible = rule_word([(i, v.scores[d]) for i, d in enumerate(SCORED_DOMAINS)])
        return [
            f"IF((({possible}) & {1 << i}L) != 0, CAST({v.scores[d].matches('_low')} AS BIGINT), 0L)"
            for i, d in enumerate(SCORED_DOMAINS)
        ]


class Lifted:
    """Named access to the lifted columns: current turn, whole context, previous turns, look-backs."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.n_before = F.col("pos")

    def _bit(self, column: str, i: int) -> Column:
        return F.expr(f"({column} & {1 << i}L) != 0")

    def cur(self, name: str) -> Column:
        return self._bit(f"feat[{Layout.CURRENT}]", self.layout.current_names.index(name))

    def ctx(self, name: str) -> Column:
        return self._bit(f"slot{Layout.CONTEXT}", self.layout.context_names.index(name))

    def hist(self, name: str) -> Column:
        return self._bit("hist_bits", self.layout.context_names.index(name))

    def score(self, i: int) -> Column:
        return F.col(f"slot{self.layout.score_slot + i}")

    def context_chars(self) -> Column:
        """Characters of the current turn and all turns before it."""
        return F.col(f"slot{self.layout.chars_slot}")

    def plugin(self, i: int) -> Column:
        return self._bit(f"slot{self.layout.plugin_slot + i // WORD_BITS}", i % WORD_BITS)

    def _recent(self, n: int) -> str:
        return f"(before{n} | feat[{Layout.NEAR}])"

    def keywords(self) -> Column:
        """Hits of the current turn in vocabulary order, then crisis and unsafe hits of the last six turns."""
        lay = self.layout
        early = [f"{g}:{w}" for g, w in lay.near_words if g in ("crisis", "unsafe")]
        word = f"feat[{lay.keyword_slot} + CAST(i DIV {WORD_BITS} AS INT)]"
        now = f"filter({string_array(f'{g}:{w}' for g, w in lay.keywords)}, (k, i) -> (shiftright({word}, i % {WORD_BITS}) & 1L) = 1)"
        if not early:
            return F.expr(now)
        before = f"filter({string_array(early)}, (k, i) -> (shiftright(before{LOOKBACK_RISK}, i) & 1L) = 1)"
        return F.expr(f"array_union({now}, {before})")

    def structures(self) -> Column:
        names = list(self.layout.vocab.structures)
        flags = [F.when(self.cur(n), F.lit(n)) for n in names]
        return F.array_compact(F.array(*flags, F.when(self.n_before > 0, F.lit("has_history"))))

    def urgency(self) -> Column:
        mask = self.layout.near_mask("urgency")
        hits = F.expr(f"bit_count({self._recent(LOOKBACK_URGENCY)} & {mask}L)")
        return F.when(hits >= 2, F.lit("high")).when(hits == 1, F.lit("medium")).otherwise(F.lit("low"))

    def affect(self) -> Column:
        return (
            F.when(self._bit(self._recent(LOOKBACK_RISK), self.layout.distress_bit), F.lit("distressed"))
            .when(self.cur("frustrated"), F.lit("frustrated"))
            .when(self.cur("positive"), F.lit("positive"))
            .otherwise(F.lit("neutral"))
        )

    def near_group(self, group: str, n: int) -> Column:
        return F.expr(f"({self._recent(n)} & {self.layout.near_mask(group)}L) != 0")

    def small_talk_before(self) -> Column:
        return self._bit(f"before{LOOKBACK_TOPIC}", self.layout.small_talk_bit)
