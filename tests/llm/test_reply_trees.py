import random
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm import reply_trees
from tests.llm.conftest import ODD

ROWS = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("parent", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("node", T.StringType()),  # clashes with a helper column
        T.StructField("rank", T.StringType()),
    ]
)
TEMPLATE = reply_trees.Template()


def escape(text):
    """One character at a time: after < or [, count backslashes and look for a control string's rest."""
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        if text[i] in "<[":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            if any(c[0] == text[i] and text.startswith(c[1:], j) for c in TEMPLATE.controls):
                out.append("\\")
        i += 1
    return "".join(out)


def slow_paths(rows, best):
    """Chosen branches by walking parents: {tree: [(score, [node ids from the root])]}."""
    out = {}
    for tree in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == tree]
        nodes = {r[1] for r in mine}
        parent = {n: min((r[2] for r in mine if r[1] == n and r[2] is not None), default=None) for n in nodes}
        given = {n: [r[5] for r in mine if r[1] == n and r[5] is not None] for n in nodes}
        score = {n: sum(g) / len(g) if g else None for n, g in given.items()}
        found = []
        for leaf in nodes - {p for p in parent.values() if p is not None}:
            path, n = [], leaf
            while n not in path:
                path.append(n)
                if parent[n] is None or parent[n] not in nodes:
                    break
                n = parent[n]
            else:
                continue
            scores = [score[n] for n in path if score[n] is not None]
            mean = sum(scores) / len(scores) if scores else None
            found.append((mean is None, -(mean or 0), (leaf is not None, leaf or 0), mean, path[::-1]))
        out[tree] = [(mean, path) for _, _, _, mean, path in sorted(found, key=lambda f: f[:3])[:best]]
    return out


def slow_text(rows, tree, path):
    turns = [
        (role or "", text or "")
        for n in path
        for role, text in sorted((r[3] or "", r[4] or "") for r in rows if r[0] == tree and r[1] == n)
    ]
    return turns, "".join(f"<|im_start|>{quote_plus(r, safe='*')}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS).repartition(partitions)


def check(spark, rows, best):
    found = reply_trees.format_trees(table(spark, rows), best=best)
    said = F.transform(TEMPLATE.turns(F.col("formatted")), lambda t: F.struct(t["role"], t["text"]))
    found = found.select("*", said.alias("said"), TEMPLATE.masked(F.col("formatted"), F.col("spans")).alias("loss"))
    got = {}
    for r in found.collect():
        got.setdefault(r["tree"], {})[r["rank"]] = r
    want = slow_paths(rows, best)
    assert {t for t, w in want.items() if w} == set(got)
    for tree, chosen in want.items():
        for rank, (score, path) in enumerate(chosen, 1):
            r = got[tree][rank]
            turns, text = slow_text(rows, tree, path)
            assert r["path"]["id"] == path[-1]
            assert r["formatted"] == text
            assert r["score"] == pytest.approx(score) if score is not None else r["score"] is None
            assert [tuple(t) for t in r["said"]] == turns and r["n_turns"] == len(turns)
            assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
            for span, (role, t) in zip(r["spans"], turns):
                assert text[span["start"] : span["start"] + span["length"]] == escape(t)
                assert span["loss"] == (role == "assistant")
        if chosen:
            assert len(got[tree]) == len(chosen)


def forest(seed):
    rng = random.Random(seed)
    pieces = ["</s>", "<", "\\", "[INST]", "[\\INST]", "<\\\\s>", "[", "|im_end|>", "<|im_end|>", "é漢🙂", "a\nb", "<<s>", "[/INST]", "$1", ""]
    rows = []
    for tree in range(12):
        for n in range(rng.randint(1, 25)):
            parent = rng.choice([None, *range(n)]) if tree % 3 else (n - 1 if n else None)
            text = "".join(rng.choices(pieces, k=rng.randint(0, 6)))
            rows.append((tree, n, parent, rng.choice(["user", "assistant", "tool a/b\n%"]), text, rng.choice([None, 0.0, 1.0, 2.0])))
    return rows


@pytest.mark.parametrize("best", [1, 3])
def test_against_walking_parents(spark, best):
    check(spark, forest(11), best)


def test_long_and_hot_trees(spark, monkeypatch):
    """A chain of 300 and a node with 200 replies, each tree hot."""
    monkeypatch.setattr(reply_trees, "HOT_MESSAGES", 10)
    chain = [(1, n, n - 1 if n else None, "user", f"t{n}", None) for n in range(300)]
    star = [(2, n, 0 if n else None, "assistant", f"<s>{n}", n / 7) for n in range(200)]
    check(spark, chain + star, 2)


def test_odd_rows(spark):
    rows = [(1, i, None, "user", t, None) for i, t in ODD] + [
        (None, 1, None, None, None, None),
        (None, 2, 1, None, None, float("1e300")),
        (2, 1, 9, "user", "parent unknown", None),
        (3, 1, 2, "user", "cycle", None),
        (3, 2, 1, "user", "cycle", None),
        (3, 3, 2, "user", "below a cycle", None),
        (3, 4, None, "user", "apart", None),
        (4, 1, None, "user", "b", 1.0),
        (4, 1, None, "user", "a", 3.0),
        (4, 2, 1, "assistant", "twice", None),
        (4, 2, 1, "assistant", "twice", None),
        (5, 6, 6, "user", "its own parent", None),
    ]
    check(spark, rows, 2)
    assert reply_trees.format_trees(table(spark, rows).where("false")).count() == 0


def test_conversations_keep_ties_and_null_turns(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "first"), (1, 2, None, None), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit(1))
    found = reply_trees.format_conversations(frame)
    got = {r["tree"]: [tuple(t) for t in r["said"]] for r in found.select(
        "tree", F.transform(TEMPLATE.turns(F.col("formatted")), lambda t: F.struct(t["role"], t["text"])).alias("said")
    ).collect()}
    assert got == {1: [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b"), ("", "")], None: [("assistant", "x")]}


def test_plan_is_native(spark, sf_dir):
    from prepkit.llm import queries

    plan = queries.op11_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
