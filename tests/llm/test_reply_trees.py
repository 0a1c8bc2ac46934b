import random

import pytest
from pyspark.sql import functions as F

from lanewise.llm.reply_trees import best_paths, chained, escaped, format_trees, read_loss, read_turns, unescaped

SCHEMA = "tree long, node long, parent long, score double, role string, text string, extra string"


def plain_paths(rows, branches):
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        leaves = [n for n in nodes if n not in {r[2] for r in nodes.values()}]
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][2]
            paths.append(path[::-1])
        mean = lambda p: sum(nodes[n][3] or 0.0 for n in p) / len(p)
        paths.sort(key=lambda p: (-mean(p), -len(p), p[-1]))
        for rank, path in enumerate(paths[:branches], 1):
            out[tree, rank] = path
    return out


def test_best_paths(spark):
    rng = random.Random(1)
    rows = []
    for tree in range(6):
        for node in range(rng.randrange(1, 60)):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else None
            rows.append((tree, node, parent, float(rng.randrange(8)), "user", f"t{node}", None))
    rows += [(9, i, i - 1 if i else None, 1.0, "user", "x", None) for i in range(70)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in best_paths(frame, 3).collect():
        got.setdefault((r.tree, r.rank), {})[r.position] = r.node
    want = plain_paths(rows, 3)
    assert {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()} == want


CASES = ["", "\\", "\\\\|", "<|", "<\\|", "<<|end|>\n", "a\nb", "\\n", "<|turn|>user\nhi<|end|>\n", "é😀<|", "\\### Assistant: </turn> ok", "|", "\\|"]


@pytest.mark.parametrize("role", ["assistant", "user", "a\nb", "<|end|>\n", ""])
def test_round_trip(spark, role):
    rows = [(1, i, i - 1 if i else None, None, role if i % 2 else "assistant", t, "x") for i, t in enumerate([*CASES, None, "long " * 4000])]
    done = format_trees(spark.createDataFrame(rows, SCHEMA))
    read = done.select(
        read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    assert len(read) == 1
    assert [(t.role, t.text) for t in read[0].turns] == [(r[4], r[5] or "") for r in rows]
    assert read[0].loss == "".join(r[5] or "" for r in rows if r[4] == "assistant")


def test_escape_hides_marks(spark):
    frame = spark.createDataFrame([(t,) for t in CASES], "t string")
    for r in frame.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert "<|" not in r.e and r.u == r.t


def test_odd_rows(spark):
    rows = [
        (None, 1, None, 1.0, None, "null tree", None),
        (2, None, None, 1.0, "user", "null node", None),
        (3, 1, 2, 1.0, "user", "cycle", None), (3, 2, 1, 1.0, "user", "cycle", None),
        (4, 5, 99, None, "assistant", "no such parent", None),
        (5, 1, None, 1.0, "user", "twice", None), (5, 1, None, 1.0, "user", "twice", None),
    ]
    got = {r.tree: r.formatted for r in format_trees(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        None: "<|turn|>\nnull tree<|end|>\n",
        4: "<|turn|>assistant\nno such parent<|end|>\n",
        5: "<|turn|>user\ntwice<|end|>\n",
    }
    assert format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chained(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "z"), (None, 3, "user", "n"), (1, 0, "user", "a")]
    frame = chained(spark.createDataFrame(rows, "c long, turn long, role string, text string"), "c", ["turn"], "role", "text")
    assert sorted((r.tree or 0, r.node, r.text) for r in frame.collect()) == [(0, 1, "n"), (1, 1, "z"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b")]
