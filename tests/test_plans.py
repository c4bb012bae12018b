"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from prepkit import CleanPlan, prepare, run_clean
from prepkit.operators import charts, cleaning, encoding, outliers, sampling
from prepkit.operators import profile as P
from queryset import all_oracles, all_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    return len(re.findall(r"FileScan parquet", plan.split("Subquery")[0]))


@pytest.fixture(scope="module")
def lineitem(table):
    return table("lineitem")


def test_literal_steps_are_one_scan_without_a_shuffle(lineitem, table):
    frames = [
        cleaning.fill_missing(lineitem, "auto")[0],
        outliers.remove_outliers(lineitem, mode="joint"),
        outliers.cap_outliers(lineitem),
        encoding.label_encode(encoding.normalize(lineitem)),
        sampling.sample_fraction(lineitem, 0.1),
        sampling.assign_split(table("orders"), keys=["o_orderkey"], exact=True),
        prepare(table("orders"), "o_orderstatus", keys=["o_orderkey"]).data,
    ]
    for df in frames:
        plan = plan_of(df)
        assert scans(plan) == 1
        assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_balancing_broadcasts_the_class_plan_and_shuffles_no_rows(table):
    orders = table("orders")
    for op in (sampling.undersample, sampling.oversample):
        plan = plan_of(op(orders, "o_orderstatus", ["o_orderkey"]))
        assert scans(plan) == 1 and "BroadcastHashJoin" in plan
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_outlier_bounds_reach_the_scan(table):
    plan = plan_of(outliers.remove_outliers(table("events"), drop_null=True))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(value", plan)


def test_reports_read_only_their_columns(lineitem):
    plan = plan_of(charts.histogram(lineitem, "l_quantity"))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"l_quantity:double"}
    plan = plan_of(P.class_distribution(lineitem, "l_returnflag"))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"l_returnflag:string"}


def test_null_counts_are_one_scan(lineitem):
    assert scans(plan_of(P.null_counts(lineitem))) == 1


def test_scatter_keeps_a_bounded_heap(lineitem):
    plan = plan_of(charts.scatter(lineitem, "l_quantity", "l_tax"))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_long_texts_stay_out_of_the_duplicate_shuffle(table):
    plan = plan_of(P.duplicate_rows(table("documents")))
    assert "sha2" in plan
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and all("text" not in k for k in keys)


NO_ORACLE = {"dataset_size", "fleet_bytes"}


def test_every_query_has_sql_but_the_file_sizes():
    assert set(all_queries()) - set(all_oracles()) == NO_ORACLE
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", ["profile_whole_table", "correlation_matrix", "clean_customer",
                                  "domain_tag_documents", "readiness_score", "split_stratified"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = plan_of(all_queries()[name](spark, sf_dir))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_clean_steps_are_recorded(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (3, "b", None), (4, "b", 100.0)],
        "id int, s string, x double",
    )
    plan = CleanPlan(
        remove_duplicates=True,
        missing_strategy_map={"s": "drop", "x": "fill_median"},
        convert_types={"id": "str", "s": "int"},
        normalize=True,
        encode_categoricals=True,
    )
    result = run_clean(df, plan, detect=True)
    steps = [(r["operation"], r["rows_before"], r["rows_after"]) for r in result.effects().collect()]
    assert steps == [
        ("remove_duplicates", 5, 4),
        ("handle_missing", 4, 3),
        ("convert_types", 3, 3),
        ("normalize", 3, 3),
        ("encode_categoricals", 3, 3),
    ]
    outcomes = {r["column_name"]: r["outcome"] for r in result.conversions.collect()}
    assert outcomes == {"id": "converted", "s": "failed"}
    assert [r["column_name"] for r in result.outliers.collect()] == ["x"]
    got = sorted(tuple(r) for r in result.data.collect())
    assert [g[2] for g in got] == pytest.approx([0.0, 0.5, 1.0])
    nulls = {r["column_name"]: (r["nulls_before"], r["nulls_after"]) for r in result.null_counts().collect()}
    assert nulls == {"id": (0, 0), "s": (1, 0), "x": (1, 0)}


def test_nothing_to_do(spark):
    df = spark.range(3)
    result = run_clean(df, CleanPlan())
    assert result.data is df and result.effects().count() == 0


def test_prepare_fits_on_train_only(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") * 2.0).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"),
        F.lit(1).alias("y"),
    )
    everything = prepare(df, "y", keys=["id"])
    assert everything.data.columns == ["id", "x", "s", "y", "split"]
    assert tuple(everything.sizes().first()) == (800, 200)
    low = everything.data.agg(F.min("x"), F.max("x")).first()
    assert tuple(low) == (0.0, 1.0)
    fitted = prepare(df, "y", keys=["id"], fit_on="train")
    span = fitted.train().agg(F.min("x"), F.max("x")).first()
    assert tuple(span) == (0.0, 1.0) and fitted.test().count() == 200
    with pytest.raises(ValueError):
        prepare(df, fit_on="test")
