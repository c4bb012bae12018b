import random

import pyarrow as pa
from pyspark.sql import functions as F

from prepkit.llm import line_dedup
from tests.llm.conftest import ODD

SPACE = " \t\n\x0b\x0c\r"


def slow(rows, min_chars=40, min_docs=5):
    """Kept texts by brute force, for rows of distinct ids."""
    holders = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key_of = lambda line: line.strip(SPACE).translate(lower)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {
        i: None if text is None else "\n".join(x for x in text.split("\n") if gone.get(key_of(x), i) == i)
        for i, text in rows
    }


def test_corpus(docs, corpus):
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(docs(corpus)).collect()}
    assert kept == slow(corpus)


def test_very_common_lines_over_many_partitions(spark, docs):
    rng = random.Random(3)
    common = [c * 45 for c in "abc"]
    rows = []
    for i in range(400):
        lines = [rng.choice([*common, " " + common[0].upper() + "\t", f"own {i} " * 9, "short"]) for _ in range(6)]
        rows.append((i, "\n".join(lines)))
    frame = docs(rows, 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept == slow(rows)


def test_bounds_of_length_and_number(docs):
    long, short = "é" * 40, "é" * 39
    rows = [(i, f"{long}\n{short}\n{i}") for i in range(5)] + [(10 + i, "four " * 10) for i in range(4)]
    found = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(docs(rows)).collect()}
    assert [found[i]["n_dropped"] for i in range(5)] == [1, 1, 1, 1, 0]
    assert all(found[10 + i]["n_dropped"] == 0 and found[10 + i]["keep"] is None for i in range(4))
    assert line_dedup.kept_text(f"{long}\n{short}\n0", found[0]["keep"]) == f"{short}\n0"


def test_repeated_rows_count_once_and_lines_repeat_in_the_keeper(docs):
    line = "the same long line in several documents, again"
    rows = [(1, line)] * 4 + [(2, line), (3, line), (4, f"{line}\n{line}")]
    assert {r["n_dropped"] for r in line_dedup.keep_bitmaps(docs(rows)).collect()} == {0}
    rows.append((0, line + "  "))
    kept = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_shared_lines(docs(rows)).collect())
    assert kept == [(0, "")] + [(1, "")] * 4 + [(2, ""), (3, ""), (4, f"{line}\n{line}")]


def test_same_id_with_other_text_and_null_ids(docs):
    line = "a line of more than forty characters that all of them have"
    rows = [(i, line) for i in range(4)] + [(3, line + "\nmore"), (None, line), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in line_dedup.drop_shared_lines(docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted(
        [(0, ""), (1, ""), (2, ""), (3, line), (3, line + "\nmore"), (None, ""), (None, None)], key=repr
    )


def test_odd_rows_and_clashing_columns(docs):
    frame = docs(ODD).withColumn("key", F.lit(1)).withColumn("version", F.lit(2)).withColumn("row", F.lit(3))
    out = line_dedup.drop_shared_lines(frame)
    assert out.columns == frame.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, frame.collect()))
    sizes = {(r["doc_id"], r["n_lines"]) for r in line_dedup.keep_bitmaps(frame).collect()}
    assert {(1, 1), (2, 1), (8, 4)} <= sizes
    assert line_dedup.keep_bitmaps(frame.where("false")).count() == 0


def test_a_hot_line_is_streamed(monkeypatch):
    """A partition of one line only is passed on in small batches, not held until its end."""
    monkeypatch.setattr(line_dedup, "_BATCH", 50)
    names = ["key", "doc", "version", "lines"]
    rows = [(b"k", i, 0, [0]) for i in range(1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 100])], names=names) for at in range(0, 1000, 100)]
    taken = []

    def read():
        for batch in batches:
            taken.append(1)
            yield batch

    sizes = []
    for out in line_dedup._stream(5)(read()):
        assert sum(sizes) + out.num_rows <= 100 * len(taken) + 2
        sizes.append(out.num_rows)
    assert max(sizes) <= 50 and sum(sizes) >= 1000 and len(sizes) >= 20


def test_bitmaps_are_made_and_applied_in_stages_of_their_own(docs, monkeypatch):
    """One Python evaluation in each plan, so a task never holds two workers."""
    plans, write = {}, line_dedup.materialize

    def spy(frame, label):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return write(frame, label)

    monkeypatch.setattr(line_dedup, "materialize", spy)
    line = "a line of more than forty code points, found everywhere"
    out = line_dedup.drop_shared_lines(docs([(i, f"{line}\nmine {i}") for i in range(8)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plans["bitmaps"].count("ArrowEvalPython") == 1
    assert sum(line in r["text"] for r in out.collect()) == 1
