"""Exact quantiles against numpy, on the direct path and on the bracket path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.operators import aggregates as A

PROBS = (0.0, 0.25, 0.5, 0.99)


def skewed(spark, rows=20000):
    """A third of the rows carry one value; the rest is spread unevenly."""
    i = F.col("id")
    return spark.range(0, rows, 1, 4).select(
        F.when(i % 3 == 0, 5.0).otherwise(F.pow((i * 7919) % 10007, 2) / 1000).alias("a"),
        (i * 31 % 1009).alias("b"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(-i).alias("c"),
        F.lit(3).alias("k"),
        F.lit(None).cast("double").alias("z"),
    )


@pytest.mark.parametrize("window_rows,sample_rows", [(10**9, 10**9), (300, 2000), (40, 300)])
def test_matches_numpy(spark, window_rows, sample_rows):
    df = skewed(spark)
    got = A.exact_quantiles(
        df, df.columns, PROBS, window_rows=window_rows, sample_rows=sample_rows
    )
    local = df.toPandas()
    for c in ("a", "b", "c", "k"):
        want = np.quantile(local[c].dropna().astype(float), PROBS)
        assert [got[c][p] for p in PROBS] == pytest.approx(list(want), rel=1e-12)
    assert set(got["z"].values()) == {None}


def test_brackets_shrink_what_is_ranked(spark, monkeypatch):
    df = skewed(spark)
    seen = []
    real = A._rank_values

    def spy(frame, brackets):
        seen.extend(brackets)
        return real(frame, brackets)

    monkeypatch.setattr(A, "_rank_values", spy)
    A.exact_quantiles(df, ["a", "b"], (0.5,), window_rows=600, sample_rows=5000)
    assert all(b.lo is not None for b in seen)
    assert all(b.distinct <= 600 or b.stuck for b in seen)


def test_long_columns_of_few_values_are_ranked_whole(spark, monkeypatch):
    """Their rows alone make no brackets, and brackets cost no sketch each and no copy of every row."""
    df = skewed(spark)
    seen, sketches, frames = [], [], []
    real, counted = A._rank_values, F.approx_count_distinct

    def spy(frame, brackets):
        seen.extend(brackets)
        return real(frame, brackets)

    monkeypatch.setattr(A, "_rank_values", spy)
    monkeypatch.setattr(A.F, "approx_count_distinct", lambda *a: sketches.append(a) or counted(*a))
    unpivot = type(df).unpivot
    monkeypatch.setattr(type(df), "unpivot", lambda self, *a: frames.append(self) or unpivot(self, *a))
    got, distinct = A.rank_columns(df, ["b", "c", "k"], (0.25, 0.5), window_rows=3000, sample_rows=5000)
    assert {b.column for b in seen if b.lo is None} == {"b", "k"} == set(distinct)
    assert distinct == {"b": 1009, "k": 1} and len(sketches) == 3
    local = df.toPandas()
    for c in ("b", "c", "k"):
        assert list(got[c].values()) == pytest.approx(list(np.quantile(local[c].dropna().astype(float), (0.25, 0.5))))
    assert [f.count() for f in frames] == [20000, sum(b.inside for b in seen if b.column == "c")]


def test_a_misleading_sample_does_not_change_the_result(spark, monkeypatch):
    df = skewed(spark)
    real = A._Bracket.guess_edges
    calls = []

    def misled(self, rate):
        calls.append(1)
        if len(calls) <= 3:  # the first guesses miss the rank altogether
            return F.percentile_approx(self.cell(), F.array(F.lit(0.9), F.lit(0.95)), 100)
        return real(self, rate)

    monkeypatch.setattr(A._Bracket, "guess_edges", misled)
    got = A.exact_quantiles(df, ["b"], (0.25,), window_rows=100, sample_rows=1000)
    assert got["b"][0.25] == np.quantile(df.toPandas()["b"], 0.25)


def test_nearest(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    got = A.exact_quantiles(df, ["x"], (0.25, 0.5, 0.75), "nearest")["x"]
    assert got == {0.25: 2.0, 0.5: 3.0, 0.75: 3.0}
    with pytest.raises(ValueError):
        A.exact_quantiles(df, ["x"], interpolation="middle")


def test_known_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    assert A.exact_quantiles(df, ["x"])["x"] == {0.25: 1.75, 0.5: 2.5, 0.75: 4.75}
    empty = df.where("false")
    assert A.exact_quantiles(empty, ["x"])["x"] == {0.25: None, 0.5: None, 0.75: None}
    assert A.exact_quantiles(df, []) == {}
