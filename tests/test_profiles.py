"""Items of a session across turn boundaries, against the patterns on the joined text."""

import random
import re

import pytest

from turnloom.operators import profiles
from turnloom.operators.profiles import session_items, with_following

WORK = re.compile(r"(?i)\b(?:building|working on|creating|making|debugging|launching)\s+([^.\n]{3,70})", re.ASCII)
STUDY = re.compile(r"(?i)\b(?:study at|student at|from)\s+([^.\n]{3,50})", re.ASCII)


def test_phrases_across_turns(spark):
    rng = random.Random(3)
    pieces = ["I am working on", "the parser.", "from", "Delft", "", "  ", "x", "building\n", "a boat", "making it", "no.", "student at  ", "ab"]
    talks = [[rng.choice(pieces) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    rows = [(c, t, "user", text) for c, texts in enumerate(talks) for t, text in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frames = spark.createDataFrame([(c, "general", "other") for c in range(len(talks))], "conv_id long, domain string, intent string")
    got = {r.conv_id: r for r in session_items(turns, frames).collect()}
    for c, texts in enumerate(talks):
        for pattern, column, title in ((WORK, "active_context", "current_work: "), (STUDY, "profile", "profile_fact: ")):
            found = pattern.search("\n".join(texts))
            assert got[c][column] == ([title + found.group(1).strip()] if found else []), texts


def test_following_across_segments(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(["a", "", "b", " ", "", "", "c", ""])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.following) for r in with_following(turns, size=3).collect())
    assert [f for _, f in got] == ["b", "b", "c", "c", "c", "c", None, None]


def plain_fold(rows):
    from turnloom.operators.profiles import LIST_SIZES, fold_lists

    users = {}
    for user, seq, *added in sorted(rows, key=lambda r: (r[0], r[1])):
        state = users.setdefault(user, [{c: [] for c in LIST_SIZES}, 0, 0])
        fold_lists(state[0], dict(zip(LIST_SIZES, added, strict=True)))
        state[1], state[2] = state[1] + 1, seq
    return {u: (*(lists[c] for c in LIST_SIZES), n, last) for u, (lists, n, last) in users.items()}


@pytest.mark.parametrize(("seed", "kinds", "size"), [(1, 6, 8), (2, 14, 8), (3, 40, 16), (4, 14, 64), (5, 300, 8)])
def test_segments_folded_in_parallel_equal_a_plain_fold(spark, monkeypatch, seed, kinds, size):
    """A user with nine tenths of the sessions; lists that fill up, forget, and see items again."""
    runs = []
    real = profiles._runs
    monkeypatch.setattr(profiles, "_runs", lambda rows, wanted: runs.append(rows.count()) or real(rows, wanted))
    rng = random.Random(seed)
    rows = []
    for seq in range(300):
        user = "hot" if rng.random() < 0.9 else rng.choice("abc")
        rows.append((user, seq, *([f"{c}{rng.randrange(kinds)}" for _ in range(rng.choice([0, 1, 1, 2, 5]))] for c in "pcamb")))
    ddl = "user_id string, seq long, " + ", ".join(f"{c} array<string>" for c in profiles.LIST_SIZES)
    got = profiles.fold_user_memory(spark.createDataFrame(rows, ddl).repartition(5), size=size).collect()
    assert {r.user_id: tuple(r)[1:] for r in got} == plain_fold(rows)
    assert len(runs) <= 300 // size + 1 and (kinds > 8 or not runs)  # nothing is run again where lists never overflow
    assert profiles.fold_user_memory(spark.createDataFrame([], ddl)).count() == 0


def test_rounds_are_bounded_by_blocks_not_by_sessions(spark, monkeypatch):
    """Lists that never forget what they began with: one round for each block of a user at most, however many sessions."""
    runs = []
    real = profiles._runs
    monkeypatch.setattr(profiles, "_runs", lambda rows, wanted: runs.append(1) or real(rows, wanted))
    kinds = {"profile": (13, 4), "patterns": (5, 3), "active_context": (11, 9), "mistakes": (3, 2), "behavioral_signals": (29, 14)}
    rows = [("hot", s, *([f"{c}{(s * n + i * 7) % cycle}" for i in range(n)] for c, (cycle, n) in kinds.items())) for s in range(600)]
    ddl = "user_id string, seq long, " + ", ".join(f"{c} array<string>" for c in profiles.LIST_SIZES)
    got = profiles.fold_user_memory(spark.createDataFrame(rows, ddl).repartition(5), size=8).collect()
    assert {r.user_id: tuple(r)[1:] for r in got} == plain_fold(rows)
    assert 0 < len(runs) <= profiles.BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism
