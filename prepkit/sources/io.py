"""Reading, writing and converting tables, and what a scan says about its files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import col
from prepkit.operators.aggregates import local_frame
from prepkit.operators.profile import duplicate_rows
from prepkit.sources.csv_records import records

FORMATS = ("parquet", "csv", "json")
# CSV files above this size are cut into records by many tasks.
SPLIT_BYTES = 256 << 20
# The steps of a readable size.
SIZE_UNITS = ("B", "KB", "MB", "GB")


def file_format(path: str) -> str:
    """The format named by the extension of a path."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    return ext


# Stands for a quoted empty CSV value while a file is read, to tell it from a missing one.
_EMPTY_VALUE = "\u0000"


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first text of the files opens an array."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def _large(spark: SparkSession, path: str) -> bool:
    """Whether a file is so large that one task should not read it alone."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return bool(files.where(F.col("length") > SPLIT_BYTES).take(1))


def _inferred(spark: SparkSession, path: str, cut: DataFrame, options: dict[str, str]) -> T.StructType | None:
    """The types that Spark infers from all records, under the names of the first header.

    None where there are no records, or the first one is not as long as the header.
    """
    names = spark.read.csv(path, header=True, multiLine=True, **options).columns
    # Spark infers nothing from a blank line, which is a record where a table has one column
    texts = cut.rdd.map(lambda r: r[0] if r[0].strip() else f'"{r[0]}"')
    found = spark.read.csv(texts, header=False, inferSchema=True, **options).schema
    if len(found) != len(names):
        return None
    return T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, found)])


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read Parquet, CSV (with header) or JSON (one object per line, or an array).

    No row is lost silently: a malformed one fails the read. By default a CSV value may hold line
    breaks, and JSON files that open with an array are read as arrays. With a schema, CSV files above
    ``SPLIT_BYTES`` are cut into records by many tasks (see ``csv_records``); others, and files with
    quotes in odd places, are read by a task each. ``multi_line=False`` promises one row per line,
    ``multi_line=True`` asks for whole files.
    In CSV an empty value is null and a quoted empty one the empty string.

    Without a schema, CSV and JSON types are inferred, which costs a pass over the files; give a
    schema for large inputs.
    """
    fmt = (fmt or file_format(path)).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file type: {fmt}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        whole = _is_json_array(spark, path) if multi_line is None else multi_line
        return reader.json(path, multiLine=whole, mode="FAILFAST")
    options = {"escape": '"', "mode": "FAILFAST", "emptyValue": _EMPTY_VALUE}
    cut = records(spark, path) if multi_line is None and _large(spark, path) else None
    if cut is not None and schema is None:
        schema = _inferred(spark, path, cut, options)
    if cut is None or schema is None:
        df = reader.csv(path, header=True, inferSchema=schema is None, multiLine=multi_line is not False, **options)
    else:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
        df = cut.select(F.from_csv("record", fields, options).alias("r")).select("r.*")
    return df.select(
        *[
            F.when(col(f.name) == _EMPTY_VALUE, "").otherwise(col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write one file per partition: Parquet with snappy, CSV with header, or JSON lines."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file type: {fmt}")
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.options(
            header="true",
            escape='"',
            emptyValue='""',
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        ).csv(path)


def convert_to_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Convert a supported input to snappy Parquet and return a scan of the result."""
    write_table(read_table(spark, source, fmt, schema, multi_line), target)
    return spark.read.parquet(target)


def table_info(df: DataFrame) -> DataFrame:
    """``(row_count, distinct_rows, column_count)``; column names and types are the schema's."""
    return duplicate_rows(df).select(
        "row_count", "distinct_rows", F.lit(len(df.columns)).cast("bigint").alias("column_count")
    )


def readable_size(size: int) -> str:
    """Bytes as B, KB, MB or GB with two decimals above bytes."""
    step = 0
    while step < 3 and size >= 1024 ** (step + 1):
        step += 1
    return f"{size} B" if step == 0 else f"{size / 1024**step:.2f} {SIZE_UNITS[step]}"


def size_text(size: Column) -> Column:
    """:func:`readable_size` of a column of bytes; null for null."""
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = F.concat(F.format_string("%.2f", size / 1024.0**i), F.lit(" " + unit))
        scaled = F.when(size.isNotNull(), scaled)
        text = text.when(size < 1024 ** (i + 1), scaled) if unit != "GB" else text.otherwise(scaled)
    return text


def stored_files(df: DataFrame) -> DataFrame:
    """``(path, length)`` of the files behind a scan, with or without rows; their content is not read."""
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(p)) for p in df.inputFiles()]
    if not paths:
        return local_frame(df.sparkSession, [], "path string, length bigint")
    return df.sparkSession.read.format("binaryFile").load(paths).select("path", "length")


def dataset_size(df: DataFrame) -> DataFrame:
    """``(files, total_bytes, readable)`` of the files behind a scan; no row of them is read."""
    found = stored_files(df).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    return found.withColumn("readable", size_text(F.col("total_bytes")))


def preview(df: DataFrame, limit: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows; with ``order_by`` the first in that order."""
    if limit < 1:
        raise ValueError(f"limit must be 1 or more: {limit}")
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(limit)


def preview_columns(df: DataFrame) -> DataFrame:
    """``(column_name, data_type)`` shown above a preview."""
    return local_frame(df.sparkSession, df.dtypes, "column_name string, data_type string")
