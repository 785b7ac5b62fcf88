import random

from turnloom.operators.logs import compact_logs, fold_repeats, fold_stacks
from turnloom.operators.profiles import LIST_SIZES, fold_lists, fold_user_memory


def test_repeated_blocks():
    mark = "... [{} IDENTICAL BLOCKS COMPRESSED BY X] ..."
    assert fold_repeats(["a", "a"], "X") == ["a", "a"]
    assert fold_repeats(["a", "a", "a", "b"], "X") == ["a", mark.format(2), "b"]
    assert fold_repeats(["a", "b"] * 3, "X") == ["a", "b", mark.format(2)]
    assert fold_repeats(list("abcde") * 3 + ["z"], "X") == [*"abcde", mark.format(2), "z"]
    assert fold_repeats(["", "", "", ""], "X") == ["", "", "", ""]


def test_stack_runs():
    six, seven = ["  at f"] * 6, [f" at {i}" for i in range(7)]
    assert fold_stacks([*six, "end"], "X") == [*six, "end"]
    assert fold_stacks(seven, "X") == [*seven[:3], "... [1 STACK TRACE LINES COMPRESSED BY X] ...", *seven[-3:]]


def test_long_lines_and_native_path(spark):
    rows = [(1, "x" * 300), (2, "y" * 301), (3, "e\n" + "s\n" * 3 + "t")]
    got = {r.id: r.compacted for r in compact_logs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[1] == "x" * 300
    assert got[2] == "y" * 150 + " ... [LONG LINE OF 301 CHARS TRUNCATED] ... " + "y" * 50
    assert got[3] == "e\ns\n... [2 IDENTICAL BLOCKS COMPRESSED BY CTX] ...\nt"


def test_user_memory_matches_a_sequential_fold(spark):
    rng = random.Random(4)
    rows, last = [], {}
    for seq in range(300):
        user = rng.choice(["hot", "hot", "hot", "b"])
        if user not in last or rng.random() < 0.4:
            last[user] = {c: rng.sample([f"{c}{i}" for i in range(size + 4)], rng.choice([0, 1, 3, size, size + 1, size + 3])) for c, size in LIST_SIZES.items()}
        rows.append((user, seq, *[last[user][c] for c in LIST_SIZES]))
    want = {}
    for user, seq, *lists in rows:
        state = want.setdefault(user, [{c: [] for c in LIST_SIZES}, 0])
        fold_lists(state[0], dict(zip(LIST_SIZES, lists)))
        state[1] += 1
    ddl = "user_id string, seq long, " + ", ".join(f"{c} array<string>" for c in LIST_SIZES)
    got = {r.user_id: r for r in fold_user_memory(spark.createDataFrame(rows, ddl).repartition(5), size=64).collect()}
    for user, (lists, version) in want.items():
        assert {c: got[user][c] for c in LIST_SIZES} == lists and got[user].version == version
