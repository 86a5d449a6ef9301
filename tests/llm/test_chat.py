import hashlib

from searchloom.llm import chat
from searchloom.llm.common import Scratch
from searchloom.llm.queries import op9_chat

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string, node string, score string"


def digest(rows):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_query(spark):
    per = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        per.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: tuple(r)[1:5] for r in op9_chat(spark, SF).collect()}
    assert got == {k: digest(v) for k, v in per.items()}


def test_awkward_rows_round_trip(spark):
    odd = ["", None, "\\", "\\\\<s>", "<", "</s", "[/INST", "[ROLE]x[/ROLE]", "a\nb", " lead and trail ", "é" * 50_000, "\\[INST]", "<s></s>"]
    rows = [(1, i, ("user", "assistant", "system", None, "[/ROLE]")[i % 5], t, "n", "s") for i, t in enumerate(odd)]
    rows += [(None, 1, "assistant", "x", None, None), (None, None, "user", "y", None, None), (3, 1, "user", "same", "", ""), (3, 1, "user", "same", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    s = Scratch(spark)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(chat.as_tree(df), s)).collect()}
    assert got[1] == digest([(r[2], r[3]) for r in rows[: len(odd)]])
    assert got[None] == digest([("user", "y"), ("assistant", "x")]) and got[3][0] == 2
    assert chat.format_conversations(chat.as_tree(df.limit(0)), s).count() == 0


def test_empty_and_missing_ids_are_two_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), ("", 1, "user", "c"), ("", 2, "assistant", "d"), ("=", 1, "user", "e")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(chat.as_tree(df), Scratch(spark))).collect()}
    assert got == {None: digest([("user", "a"), ("assistant", "b")]), "": digest([("user", "c"), ("assistant", "d")]), "=": digest([("user", "e")])}


def test_several_paths_of_several_trees(spark):
    nodes = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 1.0), (5, 2, 1.5), (10, None, 1.0), (11, 10, 1.0), (20, 99, 2.0)]
    df = spark.createDataFrame([("c", n, p, s, 7, "user" if n % 2 else "assistant", f"t{n}") for n, p, s in nodes], "conv string, node long, parent long, score double, conv_id long, role string, text string")
    s = Scratch(spark)
    leaves = lambda k: sorted({r.leaf for r in chat.best_paths(df, s, k).collect()})
    assert leaves(1) == [3, 11, 20] and leaves(2) == [3, 5, 11, 20] and leaves(9) == [3, 4, 5, 11, 20]
    assert sorted(r.n_turns for r in chat.format_conversations(df, s, 2).collect()) == [1, 2, 2, 3]


def test_best_branch_of_a_tree(spark):
    nodes = [("c", 1, None, 0.0), ("c", 2, 1, 1.0), ("c", 3, 1, 5.0), ("c", 4, 2, 1.0), ("c", 5, 4, 9.0), ("c", 6, 3, 1.0)] + [("d", i, i - 1 if i > 1 else None, 1.0) for i in range(1, 70)]
    df = spark.createDataFrame(nodes, "conv string, node long, parent long, score double")
    got = sorted((r.conv, r.depth, r.node) for r in chat.best_paths(df, Scratch(spark)).collect())
    assert got == [("c", 0, 1), ("c", 1, 2), ("c", 2, 4), ("c", 3, 5)] + [("d", i - 1, i) for i in range(1, 70)]
