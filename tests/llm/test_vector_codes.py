import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from prepkit.llm import queries, vector_codes

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.StringType()),
        T.StructField("code", T.StringType()),  # clashes with a result column
    ]
)


def slow(rows, parts=16, entries=64, rounds=2, scale=256):
    """(code, error) by row, the codebooks, by plain loops over Python integers."""
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    d = len(ints[0][1]) // parts
    cut = [(i, [v[p * d : (p + 1) * d] for p in range(parts)]) for i, v in ints]
    first = [v for _, v in sorted(cut)][:entries]
    books = [[v[p] for v in first] for p in range(parts)]

    def best(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            held = {}
            for _, v in cut:
                held.setdefault(best(p, v[p])[0], []).append(v[p])
            for e, some in held.items():
                new[p][e] = [sum(x) // len(some) for x in zip(*some)]
        books = new
    out = []
    for _, v in cut:
        found = [best(p, v[p]) for p in range(parts)]
        out.append(("".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found)))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, lab, "old") for i, v, lab in rows], ROWS).repartition(partitions)


@pytest.mark.parametrize("size", [0.3, 0.02, 1e6, 1e15])
def test_against_plain_loops(spark, size):
    """Spread vectors, ones with many ties, and numbers that 64-bit squares do not hold."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(32)], str(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[7][1], None) for i in range(40)]
    books = vector_codes.train(table(spark, rows))
    got = {r["vec_id"]: r for r in vector_codes.encode(table(spark, rows, 5), books).collect()}
    want, digest = slow([(i, v) for i, v, _ in rows])
    assert books.sha256() == digest
    for (i, _, _), (code, error) in zip(rows, want):
        assert (got[i]["code"], got[i]["error"]) == (code, min(error, 2**63 - 1))


def test_query_digests(spark, sf_dir, table):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings").collect()]
    want, digest = slow([(i, v) for i, v, _ in rows])
    got = {r["vec_id"]: r for r in queries.op13_vector_codes(spark, sf_dir).collect()}
    totals = {}
    for (_, _, label), (_, error) in zip(rows, want):
        totals[label] = totals.get(label, 0) + error
    for (i, _, label), (code, error) in zip(rows, want):
        assert tuple(got[i])[1:] == (code, error, totals[label], digest)


def test_odd_rows(spark):
    rng = random.Random(9)
    good = [(i, [rng.gauss(0, 1) for _ in range(16)], "a") for i in range(20)]
    odd = [
        (100, None, "a"), (101, [], "a"), (102, [1.0] * 15, "a"), (103, [1.0] * 32, "a"), (104, [None] + [1.0] * 15, "a"),
        (105, [float("nan")] + [1.0] * 15, "a"), (106, [float("inf")] + [1.0] * 15, "a"),
        (None, [0.5] * 16, None), (3, good[3][1], "a"),
    ]
    frame = table(spark, good + odd)
    books = vector_codes.train(frame)
    assert books.entries.shape == (16, 22, 1)  # the rows with usable vectors
    coded = vector_codes.encode(frame, books, keep=["vec_id", "label"])
    rows = vector_codes.with_label_error(coded).collect()
    assert sorted(map(str, (r["vec_id"] for r in rows))) == sorted([*map(str, range(20)), "3", "None"])
    assert {r["label_error"] for r in rows if r["label"] is None} == {sum(r["error"] for r in rows if r["label"] is None)}
    assert {r["label_error"] for r in rows if r["label"] == "a"} == {sum(r["error"] for r in rows if r["label"] == "a")}
    assert vector_codes.train(frame.where("false")) is None
    assert vector_codes.encode(frame, None).count() == 0


def test_search_ends_early():
    """Entries whose sum is too far are never compared: a component beyond the gap stays unread."""
    import numpy as np

    entries = np.array([[i * 1000, 0] for i in range(64)])
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype != bool:
                seen.append(len(np.atleast_1d(key)))
            return super().__getitem__(key)

    index, far = vector_codes.nearest(np.array([[5003, 2]] * 10), entries.view(Watched))
    assert set(index) == {5} and set(far) == {13}
    assert sum(seen) <= 64 + 8 * 10  # the sums in order, and a few entries a row; all would be 640
