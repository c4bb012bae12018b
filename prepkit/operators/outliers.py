"""Outliers of numeric columns: detection, removal and capping by IQR or z-score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import clip, col
from prepkit.operators.aggregates import exact_quantiles, local_frame, one_row, summary


def iqr_quartiles(
    df: DataFrame,
    columns: Sequence[str],
    interpolation: str = "linear",
    sizes: Mapping[str, int] | None = None,
) -> dict[str, tuple[float, float]]:
    """First and third quartile of the columns that hold any value.

    ``sizes`` are upper estimates of their distinct values, if known.
    """
    found = exact_quantiles(df, columns, (0.25, 0.75), interpolation, sizes=sizes)
    return {c: (q[0.25], q[0.75]) for c, q in found.items() if q[0.25] is not None}


def outlier_bounds(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    interpolation: str = "linear",
    sizes: Mapping[str, int] | None = None,
) -> dict[str, tuple[float, float]]:
    """Bounds outside which a value is an outlier, for the columns that have any.

    ``iqr``: 1.5 interquartile ranges beyond the quartiles. ``zscore``: 3 sample deviations
    around the mean; columns with no deviation are left out.
    """
    if method == "iqr":
        return {
            c: (q1 - K.IQR_FACTOR * (q3 - q1), q3 + K.IQR_FACTOR * (q3 - q1))
            for c, (q1, q3) in iqr_quartiles(df, columns, interpolation, sizes).items()
        }
    if method != "zscore":
        raise ValueError(f"unknown method: {method}")
    stats = summary(df, columns) if columns else {}
    return {
        c: (s["mean"] - K.ZSCORE_LIMIT * s["std"], s["mean"] + K.ZSCORE_LIMIT * s["std"])
        for c, s in stats.items()
        if s["std"]
    }


def distinct_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """A sketch of the distinct values of each column, in one pass."""
    return one_row(df, {c: F.approx_count_distinct(col(c).cast("double")) for c in columns})


def detect_outliers(
    df: DataFrame, interpolation: str = "linear", sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """``(column_name, outlier_count, lower_bound, upper_bound, q1, q3)`` by IQR, per numeric
    column with values."""
    quartiles = iqr_quartiles(df, types.numeric_columns(df), interpolation, sizes)
    bounds = {
        c: (q1 - K.IQR_FACTOR * (q3 - q1), q3 + K.IQR_FACTOR * (q3 - q1))
        for c, (q1, q3) in quartiles.items()
    }
    outside = {
        c: F.count_if(((col(c) < lo) | (col(c) > hi)) & ~_is_nan(df, c)) for c, (lo, hi) in bounds.items()
    }
    counts = one_row(df, outside) if outside else {}
    rows = [(c, counts[c], *bounds[c], *quartiles[c]) for c in bounds]
    return local_frame(
        df.sparkSession,
        rows,
        "column_name string, outlier_count bigint, lower_bound double, upper_bound double, "
        "q1 double, q3 double",
    )


def _is_nan(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.isnan(col(column)), F.lit(False))
    return F.lit(False)


def _within(df: DataFrame, column: str, bounds: tuple[float, float], keep_null: bool) -> Column:
    x = col(column)
    inside = (x >= F.lit(bounds[0])) & (x <= F.lit(bounds[1]))
    return x.isNull() | _is_nan(df, column) | inside if keep_null else inside


def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    mode: str = "sequential",
    drop_null: bool = False,
    interpolation: str = "linear",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Drop rows with an outlier in any numeric column; null and NaN are none unless ``drop_null``.

    Bounds come from the finite values, so an infinite value is an outlier.

    ``sequential`` finds the bounds of each column on the rows that the columns before it left,
    one pass per column. ``joint`` takes all bounds from the input in one pass, which is what to
    use on wide tables. Bounds are literals: every pass reads the columns seen so far and pushes
    their filters into the scan.
    """
    names = list(types.numeric_columns(df) if columns is None else columns)
    if mode not in ("sequential", "joint"):
        raise ValueError(f"unknown mode: {mode}")
    steps = [names] if mode == "joint" else [[c] for c in names]
    # dropping rows adds no values, so one sketch bounds the distinct values of every step
    sizes = distinct_estimates(df, names) if method == "iqr" and len(steps) > 1 else None
    for step in steps:
        bounds = outlier_bounds(df, step, method, interpolation, sizes)
        for c, limits in bounds.items():
            df = df.where(_within(df, c, limits, not drop_null))
    return df


def _capped(df: DataFrame, column: str, bounds: tuple[float, float]) -> Column:
    return F.when(_is_nan(df, column), col(column)).otherwise(clip(col(column), *bounds))


def cap_outliers(
    df: DataFrame,
    method: str = "iqr",
    interpolation: str = "linear",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Clamp numeric columns to their bounds; the columns become doubles, null and NaN stay.

    Rows do not change, so all bounds come from one pass.
    """
    names = list(types.numeric_columns(df) if columns is None else columns)
    bounds = outlier_bounds(df, names, method, interpolation)
    return df.select(
        *[_capped(df, c, bounds[c]).alias(c) if c in bounds else col(c) for c in df.columns]
    )
