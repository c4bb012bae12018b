"""Readers, writers, sizes and the shared scratch folder."""

import pytest

from prepkit import CleanPlan, clean_to_parquet, prepare, prepare_to_parquet
from prepkit.sources import io, scratch


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [(1, 'say "x", y', 1.5, None), (2, "ü", None, True)], "i bigint, s string, d double, b boolean"
    )
    path = str(tmp_path / f"t.{fmt}")
    io.write_table(df, path, fmt)
    back = io.read_table(spark, path, schema=None if fmt == "parquet" else df.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_line_breaks_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "i int, s string")
    path = str(tmp_path / "t.csv")
    io.write_table(df, path, "csv")
    back = io.read_table(spark, path, schema=df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == [(1, "a\nb"), (2, "c")]


def test_json_array_file_is_converted(spark, tmp_path):
    source = tmp_path / "t.json"
    source.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    got = io.convert_to_parquet(spark, str(source), str(tmp_path / "t.parquet"), multi_line=True)
    assert got.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(r["a"] for r in got.collect()) == [1, 2]


def test_csv_types_are_inferred(spark, tmp_path):
    source = tmp_path / "t.csv"
    source.write_text("a,b,c\n1,x,1.5\n2,,2.5\n")
    got = io.convert_to_parquet(spark, str(source), str(tmp_path / "t.parquet"))
    assert got.dtypes == [("a", "int"), ("b", "string"), ("c", "double")]
    assert sorted(map(tuple, got.collect())) == [(1, "x", 1.5), (2, None, 2.5)]


def test_unsupported_files(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_table(spark, "t.xlsx")
    with pytest.raises(ValueError):
        io.write_table(spark.range(1), str(tmp_path / "t"), "excel")


@pytest.mark.parametrize(
    "size,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536 * 1024, "1.50 MB"), (5 * 1024**4, "5120.00 GB")]
)
def test_readable_size(size, text):
    assert io.readable_size(size) == text


def test_dataset_size(spark, table, sf_dir):
    import os

    size = os.path.getsize(f"{sf_dir}/orders.parquet")
    row = io.dataset_size(table("orders")).first()
    assert tuple(row) == (1, size, io.readable_size(size))


def test_preview(spark):
    df = spark.range(1000)
    assert io.preview(df, 700).count() == 700 and io.preview(df, 9999).count() == 1000
    assert [r["id"] for r in io.preview(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert [tuple(r) for r in io.preview_columns(df).collect()] == [("id", "bigint")]


def test_table_info(spark):
    df = spark.range(5).selectExpr("id % 3 AS a", "'x' AS b")
    assert tuple(io.table_info(df).first()) == (5, 3, 2)


def test_materialize_keeps_odd_names_and_uses_the_shared_folder(spark):
    df = spark.range(3).toDF("a b.c,(d)")
    back = scratch.materialize(df)
    assert back.columns == df.columns and back.count() == 3
    files = back.inputFiles()
    assert all(scratch.scratch_dir(spark) in f for f in files)


def test_written_jobs(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 2 AS y", "cast(id % 3 as string) AS s")
    result = clean_to_parquet(df, CleanPlan(encode_categoricals=True), str(tmp_path / "clean"))
    assert result.data.count() == 50 and dict(result.data.dtypes)["s"] == "int"
    made = prepare(result.data, "y", keys=["id"])
    prepare_to_parquet(made, str(tmp_path / "train"), str(tmp_path / "test"))
    assert spark.read.parquet(str(tmp_path / "train")).count() == 40
    assert spark.read.parquet(str(tmp_path / "test")).columns == ["id", "s", "y"]
