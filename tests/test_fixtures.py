"""Literal frames with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from prepkit import profile_table
from prepkit.operators import charts, cleaning, correlation, encoding, features, outliers
from prepkit.operators import profile as P
from prepkit.operators import reports, sampling


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    data = [
        (1, 1.0, "a", True),
        (2, 2.0, "a", True),
        (3, None, "b", False),
        (10, 100.0, None, None),
        (10, 100.0, None, None),
    ]
    return spark.createDataFrame(data, "i int, d double, s string, f boolean")


def one(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_mixed_profile(mixed):
    assert rows(P.duplicate_rows(mixed)) == [(5, 4, 1)]
    assert rows(P.quality_score(mixed)) == [(5, 5, 1, 88.5)]
    d = {r["column_name"]: r for r in P.numeric_summary(mixed).collect()}
    assert d["d"]["mean"] == 50.75 and d["d"]["median"] == 51.0
    assert d["d"]["std"] == pytest.approx(56.870466852312724)
    assert (d["d"]["q25"], d["d"]["q75"], d["d"]["non_null"]) == (1.75, 100.0, 4)
    assert d["i"]["std"] == pytest.approx(4.43846820423443)
    assert (d["i"]["mean"], d["i"]["median"], d["i"]["q25"], d["i"]["q75"]) == (5.2, 3.0, 2.0, 10.0)
    counts = {r["column_name"]: r for r in P.column_counts(mixed).collect()}
    assert counts["d"]["distinct_count"] == 3 and counts["f"]["distinct_count"] == 2
    assert counts["s"]["null_pct"] == 40.0
    flags = P.categorical_flags(mixed).collect()
    assert [(r["column_name"], r["is_categorical"]) for r in flags] == [("s", False)]
    assert rows(P.top_values(mixed)) == []
    whole = {r["column_name"]: r for r in profile_table(mixed).columns().collect()}
    assert whole["f"]["is_categorical"] is None and whole["i"]["is_categorical"] is False


def test_mixed_scaling_and_codes(mixed):
    got = [r[0] for r in encoding.normalize(mixed).select("i").orderBy("i").collect()]
    assert got == pytest.approx([0, 1 / 9, 2 / 9, 1, 1])
    codes = rows(encoding.label_encode(mixed).select("i", "s"), "i")
    assert codes == [(1, 0), (2, 0), (3, 1), (10, None), (10, None)]


def test_quartiles_and_bounds(spark):
    df = one(spark, [1.0, 2.0, 3.0, 10.0])
    assert rows(outliers.detect_outliers(df)) == [("x", 1, -2.75, 9.25, 1.75, 4.75)]
    assert rows(outliers.remove_outliers(df), "x") == [(1.0,), (2.0,), (3.0,)]
    assert rows(outliers.cap_outliers(df), "x")[-1] == (9.25,)


def test_histogram(spark):
    df = one(spark, [0.0, 1.0, 2.0, 3.0, 10.0])
    got = rows(charts.histogram(df, "x", 5), "bucket")
    assert got == [(0, 0.0, 2.0, 2), (1, 2.0, 4.0, 2), (4, 8.0, 10.0, 1)]
    assert charts.histogram(df, "x", 1).agg(F.sum("n")).first()[0] == 5
    with pytest.raises(ValueError):
        charts.histogram(one(spark, ["a"], "string"), "x")


def test_constant_column(spark):
    df = one(spark, [7.0, 7.0, 7.0, None]).withColumn("y", F.monotonically_increasing_id())
    assert rows(charts.histogram(df, "x")) == [(0, 7.0, 7.0, 3)]
    assert rows(encoding.normalize(df.select("x")), "x") == [(None,), (7.0,), (7.0,), (7.0,)]
    assert outliers.remove_outliers(df, "zscore", columns=["x"]).count() == 4
    corr = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert corr["x", "y"] == 0.0 and corr["x", "x"] == 1.0


def test_constant_that_is_no_binary_fraction(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("x"), F.col("id").cast("double").alias("y"))
    corr = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert corr["x", "y"] == 0.0


def test_all_null(spark):
    df = one(spark, [None, None])
    r = P.numeric_summary(df).first()
    assert r["non_null"] == 0 and r["mean"] is None and r["q25"] is None
    assert rows(charts.histogram(df, "x")) == [] and rows(charts.box(df, "x")) == []
    assert rows(cleaning.fill_missing(df, "fill_mean")[0]) == [(None,), (None,)]
    assert rows(cleaning.fill_missing(df, "fill_mode")[0]) == [(None,), (None,)]
    assert rows(outliers.detect_outliers(df)) == []
    assert rows(encoding.normalize(df)) == [(None,), (None,)]


def test_empty(spark):
    df = spark.createDataFrame([], "x double, s string, c int")
    assert rows(P.quality_score(df)) == [(0, 0, 0, 0.0)]
    assert rows(P.missing_rate(df)) == [(0, 0, 0, 0.0)]
    assert rows(P.duplicate_rows(df)) == [(0, 0, 0)]
    assert [r["distinct_count"] for r in P.column_counts(df).collect()] == [0, 0, 0]
    assert rows(P.top_values(df)) == [] and rows(P.imbalance_warnings(df)) == []
    assert rows(P.class_distribution(df, "s")) == []
    assert rows(P.class_imbalance(df, "s")) == [(0, 0, None, None, None)]
    assert rows(charts.histogram(df, "x")) == [] and rows(charts.bar(df, "s")) == []
    assert rows(charts.scatter(df, "x", "c")) == []
    assert len(rows(correlation.correlation_matrix(df))) == 4
    assert rows(cleaning.fill_missing(df, "auto")[0]) == []
    assert rows(cleaning.cast_columns(df, {"c": "str"})[0]) == []
    assert rows(outliers.remove_outliers(df)) == [] and rows(encoding.label_encode(df)) == []
    assert rows(sampling.undersample(df, "s")) == [] and rows(sampling.sample_size(df, 3)) == []
    assert rows(sampling.assign_split(df, exact=True)) == []
    assert rows(features.target_columns(df)) == []
    score = reports.readiness_score(df).first()
    assert score["readiness_score"] == 100
    assert len(rows(reports.recommendations(df))) == 10


def test_mode_ignores_nulls_and_takes_the_smallest(spark):
    df = one(spark, ["b", "a", None, None, None], "string")
    got, handled = cleaning.fill_missing(df, "fill_mode")
    assert rows(got, "x") == [("a",)] * 4 + [("b",)] and handled == ["x"]


def test_mode_of_numbers_is_numeric(spark):
    df = one(spark, [10, 9, None], "int")
    assert rows(cleaning.fill_missing(df, "fill_mode")[0], "x") == [(9,), (9,), (10,)]


def test_mode_of_dates_decimals_and_booleans(spark):
    day = datetime.date(2024, 2, 29)
    stamp = datetime.datetime(2024, 1, 2, 3, 4, 5, 678)
    from decimal import Decimal

    df = spark.createDataFrame(
        [(day, stamp, Decimal("9.50"), True), (day, stamp, Decimal("10.25"), None), (None,) * 4],
        "a date, b timestamp_ntz, c decimal(10,2), d boolean",
    )
    got = cleaning.fill_missing(df, "fill_mode")[0]
    assert got.dtypes == df.dtypes
    assert got.where("c = 9.50").count() == 2
    assert got.select("a", "b", "d").distinct().collect() == [(day, stamp, True)]


def test_fill_strategies(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, None), (None, "b", 4.0)], "i int, s string, d double"
    )
    mean = cleaning.fill_missing(df, "fill_mean")[0]
    assert dict(mean.dtypes) == {"i": "double", "s": "string", "d": "double"}
    assert rows(mean.select("i"), "i") == [(1.0,), (1.5,), (2.0,)]
    zero = cleaning.fill_missing(df, "fill_zero")[0]
    assert rows(zero, "i") == [(0, "b", 4.0), (1, "a", 1.0), (2, "", 0.0)]
    empty, handled = cleaning.fill_missing(df, "fill_empty")
    assert handled == ["s"] and empty.where("i is null").count() == 1
    dropped, handled = cleaning.fill_missing(df, {"i": "drop", "d": "fill_mean", "nope": "drop"})
    assert rows(dropped, "i") == [(1, "a", 1.0), (2, None, 1.0)] and handled == ["i", "d"]
    full = cleaning.fill_missing(df.na.drop(), "fill_mean")[0]
    assert dict(full.dtypes)["i"] == "int"


CLASSES = [("x", i) for i in range(5)] + [("y", i) for i in range(5, 7)] + [(None, 7)]


def test_balancing_classes(spark):
    df = spark.createDataFrame(CLASSES, "c string, id int")
    under = sampling.undersample(df, "c", ["id"])
    assert rows(under.groupBy("c").count(), "c") == [("x", 2), ("y", 2)]
    over = sampling.oversample(df, "c", ["id"])
    assert rows(over.groupBy("c").count(), "c") == [("x", 5), ("y", 5)]
    per_id = {r["id"]: r["count"] for r in over.where("c = 'y'").groupBy("id").count().collect()}
    assert sorted(per_id.values()) == [2, 3]
    three = sampling.balance_to_target(df, "c", 3, ["id"])
    assert rows(three.groupBy("c").count(), "c") == [("x", 3), ("y", 3)]
    report = rows(sampling.balance_report(df, under, "c"), "class")
    assert report == [(None, 1, 0), ("x", 5, 2), ("y", 2, 2)]
    both = sampling.balance_classes(df, "c", "oversample", 4, ["id"])
    assert rows(both.groupBy("c").count(), "c") == [("x", 5), ("y", 4)]
    with pytest.raises(ValueError):
        sampling.balance_classes(df, "c", "smote")


@pytest.mark.parametrize(
    "big,small,tier",
    [(22, 2, "SEVERE"), (8, 2, "WARNING"), (4, 2, "NOTICE"), (3, 2, None), (2, 2, None)],
)
def test_tiers(spark, big, small, tier):
    df = spark.createDataFrame([("a",)] * big + [("b",)] * small, "c string")
    got = P.class_imbalance(df, "c").first()
    assert got["ratio"] == big / small and got["severity"] == tier
    assert got["is_imbalanced"] == (big / small > 1.5)


def test_exact_tiers_are_strict(spark):
    df = spark.createDataFrame([("a",)] * 20 + [("b",)] * 2, "c string")
    assert P.class_imbalance(df, "c").first()["severity"] == "WARNING"


def test_casts(spark):
    df = spark.createDataFrame([("1", 1.9), ("2", -1.9), ("x", None)], "s string, d double")
    got, report = cleaning.cast_columns(
        df, {"s": "int", "d": "INT32", "q": "int", "D2": "decimal"}
    )
    assert dict(got.dtypes) == {"s": "string", "d": "int"}
    assert sorted(r[0] for r in got.select("d").na.drop().collect()) == [-1, 1]
    assert {r[0]: r[2] for r in report.collect()} == {
        "s": "failed",
        "d": "converted",
        "q": "column not found",
        "D2": "column not found",
    }
    assert cleaning.cast_columns(df, {"s": "complex"})[1].first()["outcome"] == "unknown type"
    assert cleaning.cast_columns(df, {"d": "date"})[1].first()["outcome"] == "failed"
    assert rows(cleaning.cast_columns(df, {"d": "str"})[0], "s")[0][1] == "1.9"


def test_correlation_ignores_rows_with_a_null(spark):
    df = spark.createDataFrame(
        [(1, 2.0), (2, 4.0), (None, 6.0), (4, None)], "a int, b double"
    )
    corr = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert corr["a", "b"] == pytest.approx(1.0) and corr["b", "a"] == corr["a", "b"]
    assert rows(correlation.correlated_pairs(df)) == [("a", "b", 1.0)]
    assert rows(correlation.correlation_matrix(df.select("a"))) == []


def test_correlation_far_from_zero(spark):
    df = spark.range(1000).select(
        (F.col("id") + 1_700_000_000_000).alias("t"), (F.col("id") * -2.0).alias("v")
    )
    corr = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert corr["t", "v"] == pytest.approx(-1.0, abs=1e-9)


ODD = """
  array(1, 2) AS arr, named_struct('a', 1) AS st, map('k', 1, 'l', 2) AS m,
  CAST(1.5 AS DECIMAL(6, 2)) AS dec, true AS b, date'2024-01-01' AS day,
  timestamp_ntz'2024-01-01 00:00:00' AS ts, interval '1' day AS gap, X'00FF' AS bin,
  array(map('k', 1)) AS maps
"""


def test_odd_types(spark):
    df = spark.sql(f"SELECT {ODD} FROM range(3)").unionByName(
        spark.sql(f"SELECT {ODD}").select(
            *[F.lit(None).cast(t).alias(c) for c, t in spark.sql(f"SELECT {ODD}").dtypes]
        )
    )
    counts = {r["column_name"]: r for r in P.column_counts(df).collect()}
    assert all(r["null_count"] == 1 and r["distinct_count"] == 1 for r in counts.values())
    assert len(counts) == len(df.columns)
    assert [r["column_name"] for r in P.numeric_summary(df).collect()] == ["dec"]
    assert cleaning.remove_duplicates(df).count() == 2
    assert rows(P.duplicate_rows(df)) == [(4, 2, 2)]
    filled = cleaning.fill_missing(df, "auto")[0]
    assert filled.where("dec is null or b is null or day is null or ts is null").count() == 0
    assert sampling.assign_split(df, exact=True).count() == 4


def test_map_order_does_not_matter(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert P.column_counts(df).first()["distinct_count"] == 1
    assert cleaning.remove_duplicates(df).count() == 1


def test_odd_names(spark):
    names = ["a b", "c.d", "e`f", "g'h\"i", "class", "n", "value", "slot"]
    df = spark.createDataFrame(
        [(1.0, 2.0, "x", "y", "p", 1, "q", 5.0), (2.0, None, None, "y", "r", 2, "q", 6.0)] * 3
        + [(9.0, 3.0, "z", "w", "p", 3, "q", 7.0)],
        "a double, b double, c string, d string, e string, f int, g string, h double",
    ).toDF(*names)
    assert {r["column_name"] for r in P.column_counts(df).collect()} == set(names)
    assert {r["column_name"] for r in P.numeric_summary(df).collect()} == {"a b", "c.d", "n", "slot"}
    assert rows(P.duplicate_rows(df)) == [(7, 3, 4)]
    assert P.quality_score(df).count() == 1 and P.top_values(df).count() >= 0
    for c in ("a b", "e`f", "g'h\"i", "value"):
        assert charts.column_chart(df, c).count() >= 1
    assert charts.scatter(df, "a b", "c.d").count() == 4
    assert correlation.correlation_matrix(df).count() == 16
    assert cleaning.fill_missing(df, "auto")[0].columns == names
    assert cleaning.remove_duplicates(df).count() == 3
    assert cleaning.cast_columns(df, {"c.d": "str"})[0].columns == names
    assert outliers.remove_outliers(df).columns == names
    assert outliers.cap_outliers(df).columns == names
    assert encoding.label_encode(encoding.normalize(df)).columns == names
    for c in ("c.d", "class"):
        assert sampling.oversample(df, c).columns == names
    assert sampling.sample_stratified_size(df, "class", 4).columns == names
    assert sampling.assign_split(df, stratify="c.d").columns == names + ["split"]
    assert features.feature_suggestions(df).count() >= 1
    assert features.target_columns(df).count() >= 1
    assert reports.readiness_score(df).count() == 1
