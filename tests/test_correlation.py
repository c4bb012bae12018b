import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.operators import correlation


def wide(spark, columns, rows=300, seed=5):
    """Columns around large means, some with nulls, one constant, one without values."""
    rng = random.Random(seed)
    base = [rng.gauss(0, 1) for _ in range(rows)]
    table = []
    for i in range(rows):
        row = [1e6 * j + base[i] * (j % 3) + rng.gauss(0, 1) for j in range(columns)]
        table.append([None if j % 4 == 1 and rng.random() < 0.3 else v for j, v in enumerate(row)])
    frame = spark.createDataFrame([tuple(r) for r in table], ", ".join(f"c{j} double" for j in range(columns)))
    return frame.withColumns({"flat": F.lit(7.0), "empty": F.lit(None).cast("double")}), table


def expected(table, i, j):
    both = np.array([(r[i], r[j]) for r in table if r[i] is not None and r[j] is not None])
    both -= both.mean(axis=0)
    return float((both[:, 0] * both[:, 1]).sum() / math.sqrt((both[:, 0] ** 2).sum() * (both[:, 1] ** 2).sum()))


def test_gramian_equals_fused_sums(spark, monkeypatch):
    frame, table = wide(spark, 12)
    few = correlation.pair_correlations(frame, frame.columns)
    monkeypatch.setattr(correlation, "AGG_WIDTH", 0)
    many = correlation.pair_correlations(frame, frame.columns)
    assert few.keys() == many.keys()
    for pair, r in few.items():
        assert many[pair] == pytest.approx(r, abs=1e-9) if r is not None else many[pair] is None
    assert many["c0", "c1"] == pytest.approx(expected(table, 0, 1), abs=1e-9)
    assert many["c0", "flat"] is None and many["c0", "empty"] is None


def test_sixty_columns_with_nulls_in_two_scans(spark):
    frame, table = wide(spark, 60)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("wide", "wide correlation")
    found = correlation.pair_correlations(frame, frame.columns)
    jobs = len(tracker.getJobIdsForGroup("wide"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 8
    for i, j in ((0, 1), (1, 5), (2, 59), (58, 59)):
        assert found[f"c{i}", f"c{j}"] == pytest.approx(expected(table, i, j), abs=1e-9)


def test_five_hundred_columns(spark):
    frame = spark.range(200).select(*[(F.sin(F.col("id") * (j + 1))).alias(f"c{j}") for j in range(500)])
    found = correlation.correlation_matrix(frame)
    assert found.count() == 500 * 500
    assert found.where("col_i = col_j and corr <> 1").count() == 0


def test_not_finite_columns_are_undefined(spark, monkeypatch):
    monkeypatch.setattr(correlation, "AGG_WIDTH", 0)
    rows = [(float(i), float("nan") if i == 3 else float(i), float("inf") if i == 4 else float(-i), float(i * i)) for i in range(9)]
    frame = spark.createDataFrame(rows, "a double, nan double, inf double, b double")
    found = {(r["col_i"], r["col_j"]): r["corr"] for r in correlation.correlation_matrix(frame).collect()}
    assert found["a", "nan"] == found["inf", "b"] == 0.0
    assert found["a", "b"] == pytest.approx(np.corrcoef(range(9), [i * i for i in range(9)])[0, 1])
