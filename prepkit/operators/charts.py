"""Chart-ready data: histograms, box and bar data, scatter samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import col, cols, finite, order_hash
from prepkit.operators.aggregates import frequent_texts
from prepkit.operators.profile import numeric_summary


def _need_positive(value: int, what: str) -> None:
    if value < 1:
        raise ValueError(f"{what} must be 1 or more: {value}")


def _need_numeric(df: DataFrame, column: str, chart: str) -> None:
    if not types.is_numeric(df.schema[column].dataType):
        raise ValueError(f"{chart} needs a numeric column: {column}")


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Equal-width bins ``(bucket, bin_start, bin_end, n)``; empty bins are absent.

    The maximum falls into the last bin. One value only gives one bin, no values no rows; NaN
    and infinite values are in no bin. The range is a scalar subquery, so the rows are scanned twice and the
    shuffle carries at most ``bins`` rows per task.
    """
    _need_numeric(df, column, "histogram")
    _need_positive(bins, "bins")
    x = finite(col(column).cast("double"))
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    place = F.floor(F.try_divide(F.lit(float(bins)) * (x - lo), hi - lo)).cast("int")
    bucket = F.when(lo == hi, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))
    placed = df.where(x.isNotNull()).select(bucket.alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    b = F.col("bucket")
    return counts.select(
        "bucket",
        (lo + b * (hi - lo) / F.lit(float(bins))).alias("bin_start"),
        F.when(lo == hi, hi)
        .otherwise(lo + (b + 1) * (hi - lo) / F.lit(float(bins)))
        .alias("bin_end"),
        "n",
    )


def box(df: DataFrame, column: str) -> DataFrame:
    """Box-plot numbers of one numeric column; no row if it holds no values."""
    _need_numeric(df, column, "box plot")
    return numeric_summary(df, [column]).where(F.col("non_null") > 0).select(
        "column_name", "min", "q25", "median", "q75", "max", "mean", "std"
    )


def histogram_statistics(df: DataFrame, column: str) -> DataFrame:
    """The numbers shown beside a histogram: ``(column_name, non_null, min, max, mean, median, std,
    q25, q75)``; no row if the column holds no values."""
    _need_numeric(df, column, "histogram")
    return numeric_summary(df, [column]).where(F.col("non_null") > 0).select(
        "column_name", "non_null", "min", "max", "mean", "median", "std", "q25", "q75"
    )


def bar(df: DataFrame, column: str, limit: int = K.TOP_VALUES) -> DataFrame:
    """The most frequent non-null values ``(category, n)``; also the data of a pie chart."""
    value = col(column)
    if types.is_text(df.schema[column].dataType):
        return frequent_texts(df, column, limit).withColumnRenamed("value", "category")
    return (
        df.where(value.isNotNull())
        .groupBy(value.alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(limit)
        .select(F.col("category").cast("string").alias("category"), "n")
    )


def scatter(
    df: DataFrame, x: str, y: str, limit: int = 500, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Up to ``limit`` sampled pairs ``(x, y)`` as doubles.

    Pairs with a null or a value that is no number are dropped. The sample is the head of the
    hash order of ``keys`` (all columns by default), kept as a bounded heap in every task.
    """
    _need_positive(limit, "limit")
    names = list(keys or df.columns)

    def number(name: str) -> Column:
        return col(name).try_cast("double")

    return (
        df.select(
            number(x).alias("x"), number(y).alias("y"), order_hash(seed, cols(names)).alias("h")
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .orderBy("h", "x", "y")
        .limit(limit)
        .select("x", "y")
    )


def column_chart(df: DataFrame, column: str, chart: str = "auto", bins: int = 15) -> DataFrame:
    """The chart of a column: numeric columns give a histogram (or box), all others bars.

    Asking for bars of a numeric column gives its histogram.
    """
    if chart not in ("auto", "histogram", "box", "bar"):
        raise ValueError(f"unknown chart: {chart}")
    if chart == "box":
        return box(df, column)
    if chart == "histogram" or types.is_numeric(df.schema[column].dataType):
        return histogram(df, column, bins)
    return bar(df, column)
