"""Caps that are gone, values that are not finite, text files that lose nothing, and job counts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from prepkit.operators import aggregates, charts, cleaning, correlation, encoding, features, outliers
from prepkit.operators import profile as P
from prepkit.operators import reports
from prepkit.sources import io, scratch
from queryset import all_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------------------------------------
# text files


AWKWARD = [(1, "a\nb"), (2, ""), (3, None), (4, '"q", x'), (5, "  pad  "), (6, "back\\slash"), (7, "\r\n"), (8, "ü")]


def test_csv_loses_nothing_by_default(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "i int, s string")
    io.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert rows(io.read_table(spark, str(tmp_path / "t.csv"), schema=df.schema)) == rows(df)
    assert rows(io.read_table(spark, str(tmp_path / "t.csv"))) == rows(df)


def test_json_array_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n[\n{"a": 1},\n{"a": 2}\n]\n')
    assert rows(io.read_table(spark, str(tmp_path / "a.json"))) == [(1,), (2,)]
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(io.read_table(spark, str(tmp_path / "b.json"))) == [(1,), (2,)]


def test_broken_rows_fail(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        io.read_table(spark, str(tmp_path / "b.json"), schema="a int").collect()
    (tmp_path / "c.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        io.read_table(spark, str(tmp_path / "c.csv"), schema="a int, b int").collect()


def test_sizes_come_from_the_listing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100, numPartitions=5).where("id < 30").write.parquet(path)
    df = spark.read.parquet(path)
    sizes = {r["path"]: r["length"] for r in io.stored_files(df).collect()}
    assert len(sizes) == len(df.inputFiles())
    assert {k.rsplit("/", 1)[1]: v for k, v in sizes.items()} == {
        p.name: p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")
    }
    odd = str(tmp_path / "a b[1]{x}%20")
    df.write.parquet(odd)
    assert io.dataset_size(spark.read.parquet(odd.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"))).first()["files"] > 0
    sized = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024**4,), (None,)], "n bigint").select(io.size_text(F.col("n")))
    assert [r[0] for r in sized.collect()] == ["0 B", "1023 B", "1.00 KB", "5120.00 GB", None]


# ---------------------------------------------------------------------------------------------
# no caps


def test_values_asked_for_are_taken(spark):
    df = spark.range(3000).select("id", (F.col("id") * 1.0).alias("x"))
    assert charts.scatter(df, "id", "x", 2500).count() == 2500
    assert charts.histogram(df, "x", 500).count() == 500
    assert io.preview(df, 2000).count() == 2000
    for wrong in (lambda: charts.scatter(df, "id", "x", 0), lambda: charts.histogram(df, "x", 0), lambda: io.preview(df, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_warnings_look_at_all_values(spark):
    data = [(f"v{i}",) for i in range(20) for _ in range(40)] + [(f"rare{i}",) for i in range(10)]
    (row,) = P.imbalance_warnings(spark.createDataFrame(data, "c string")).collect()
    assert (row["ratio"], row["severity"]) == (40.0, "SEVERE")


def test_wide_tables(spark):
    df = spark.range(50).select(*[(F.col("id") * i + F.col("id") % 3).alias(f"target_{i}") for i in range(1, 25)])
    assert correlation.correlation_matrix(df).count() == 24 * 24
    assert features.target_columns(df).count() == 24 and features.target_columns(df, limit=3).count() == 3
    assert features.category_targets(df).count() == 24
    assert correlation.correlated_pairs(df).count() == 24 * 23 // 2


def test_more_than_fifty_labels(spark):
    df = spark.range(300).select((F.col("id") % 120).cast("string").alias("s"), F.col("id").cast("string").alias("t"))
    found = encoding.label_dictionaries(df, limit=120)
    assert list(found) == ["s"] and len(found["s"]) == 120


# ---------------------------------------------------------------------------------------------
# empty column lists, values that are not finite


def test_no_columns_means_none(spark):
    df = spark.createDataFrame([(1, 2), (1, 500)], "a int, b int")
    assert P.categorical_flags(df).collect() == []
    assert P.null_counts(df, []).collect() == [] and P.column_counts(df, []).collect() == []
    assert P.numeric_summary(df, []).collect() == []
    assert outliers.remove_outliers(df, columns=[]).count() == 2
    assert rows(outliers.cap_outliers(df, columns=[])) == rows(df)


def test_nan_and_infinity(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 4.0, nan, inf, None)], "x double")
    scaled = [r[0] for r in encoding.normalize(df).collect()]
    assert scaled[:5] == [0, 0.25, 0.5, 0.75, 1] and math.isnan(scaled[5]) and scaled[6] == inf and scaled[7] is None
    assert sum(r["n"] for r in charts.histogram(df, "x", 4).collect()) == 5
    s = P.numeric_summary(df).first()
    assert (s["non_null"], s["mean"], s["median"], s["min"], s["max"]) == (7, 2.0, 2.0, 0.0, 4.0)
    (report,) = outliers.detect_outliers(df).collect()
    assert (report["q1"], report["q3"], report["outlier_count"]) == (1.0, 3.0, 1)
    assert outliers.remove_outliers(df).count() == 7
    assert outliers.remove_outliers(df, drop_null=True).count() == 5
    capped = [r[0] for r in outliers.cap_outliers(df).collect()]
    assert capped[6] == 6.0 and math.isnan(capped[5])
    alone = spark.createDataFrame([(inf,), (inf,), (nan,)], "x double")
    assert charts.histogram(alone, "x").collect() == [] and outliers.detect_outliers(alone).collect() == []
    filled = cleaning.fill_missing(df, "fill_mean")[0]
    assert [r[0] for r in filled.collect()][7] == 2.0


# ---------------------------------------------------------------------------------------------
# quantiles, texts, lookups


@pytest.mark.parametrize("max_samples", [0, 20])
def test_quantiles_when_no_sample_helps(spark, max_samples):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(800)] + [0.0] * 200
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    found, _ = aggregates.rank_columns(df, ["x"], probs, window_rows=20, sample_rows=50, max_samples=max_samples)
    values.sort()
    for p in probs:
        at = p * (len(values) - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert found["x"][p] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)


def test_plain_quantiles_equal_the_ranked_ones(spark):
    df = spark.range(1000).select((F.hash("id") % 1000).cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    probs = (0.25, 0.5, 0.9)
    plain = aggregates.exact_quantiles(df, ["x", "y"], probs)
    ranked, _ = aggregates.rank_columns(df, ["x", "y"], probs)
    for c in ("x", "y"):
        assert [plain[c][p] for p in probs] == pytest.approx([ranked[c][p] for p in probs])


def test_long_texts_are_counted_without_being_shuffled(spark):
    head = "h" * 80
    data = [head + "b"] * 3 + [head + "a"] * 3 + ["short"] * 3 + ["x" * 64] * 2 + [f"{head}{i}" for i in range(30)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in data], "s string")
    counts = {v: data.count(v) for v in set(data) if v is not None}
    want = sorted(((v, n) for v, n in counts.items()), key=lambda t: (-t[1], t[0]))
    for limit in (1, 2, 4, 10):
        assert [tuple(r) for r in charts.bar(df, "s", limit).collect()] == want[:limit]
    assert aggregates.modes(df, ["s"], ["s"]) == {"s": head + "a"} == aggregates.modes(df, ["s"])


def test_large_lookup_spreads_a_hot_class(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    lookup = df.groupBy(F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = aggregates.lookup_join(df, lookup, False, F.col("c"), "k")
        assert joined.columns == ["id", "c", "k", "n"] and joined.count() == 4000
        assert joined.where("c = 'hot' AND n = 2000").count() == 2000
        assert re.search(r"hashpartitioning\(c#\d+, salt#\d+", plan_of(joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("how", "null_safe"), [("inner", False), ("left", True)])
def test_large_lookup_is_not_broadcast(spark, how, null_safe):
    """A written lookup of long runs is a few kB of Parquet, which Spark by itself would send to the driver."""
    df = spark.range(40000).select("id", F.when(F.col("id") % 8 > 0, F.col("id") % 20000).alias("c"))
    totals = df.groupBy(F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lookup, small = aggregates.settle(totals)
    assert not small
    joined = aggregates.lookup_join(df, lookup, small, F.col("c"), "k", null_safe=null_safe, how=how)
    assert joined.count() == 40000 - (0 if null_safe else 5000)
    assert joined.where("n = 2").count() == 35000
    assert "SortMergeJoin" in plan_of(joined) and "BroadcastHashJoin" not in plan_of(joined)


def test_domain_tags_search_before_the_shuffle(table):
    plan = plan_of(reports.domain_tags(table("documents"), ["source"], "text"))
    assert plan.rindex("regexp_extract_all") > plan.rindex("Exchange hashpartitioning")


# ---------------------------------------------------------------------------------------------
# scratch tables, job counts


def test_scratch_is_released(spark):
    df = scratch.materialize(spark.range(3))
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert scratch.scratch_dir(spark) in path
    with scratch.scratch_scope(spark):
        inner = scratch.materialize(spark.range(4))
        assert inner.count() == 4
    with pytest.raises(Exception):
        inner.count()
    assert df.count() == 3


# stages that adaptive execution submits by themselves count as jobs
@pytest.mark.parametrize(
    "name,most", [("clean_customer", 45), ("readiness_score", 18), ("outliers_iqr_remove_sequential", 10)]
)
def test_number_of_jobs(spark, sf_dir, name, most):
    context = spark.sparkContext
    context.setJobGroup(f"jobs of {name}", name)
    all_queries()[name](spark, sf_dir).collect()
    assert len(context.statusTracker().getJobIdsForGroup(f"jobs of {name}")) <= most
    context.setJobGroup("other", "")
