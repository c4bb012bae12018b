"""Cleaning: column and row selection, type conversion, deduplication, missing values.

Statistics that a step needs (fill values, failure counts) are one row per column. They are found
by a job of their own and enter the plan as literals, so a chain of steps stays one linear plan
over the source: filters reach the Parquet scan and nothing upstream is planned twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit import types
from prepkit.functions.columns import LONG_TEXT, col, cols, finite, fresh
from prepkit.operators.aggregates import exact_quantiles, local_frame, modes, one_row

STRATEGIES = ("drop", "fill_mean", "fill_median", "fill_mode", "fill_zero", "fill_empty")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns in the listed order; unknown names are ignored."""
    return df.select(*cols([c for c in columns if c in df.columns]))


def filter_categories(df: DataFrame, column: str, keep: Sequence) -> DataFrame:
    """Rows whose value is in ``keep``; an empty list keeps nothing."""
    return df.where(col(column).isin(list(keep)))


def filter_effect(df: DataFrame, column: str, keep: Sequence) -> DataFrame:
    """``(original_rows, kept_rows, removed_rows)`` of :func:`filter_categories`, in one scan."""
    kept = F.count_if(col(column).isin(list(keep)))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("original_rows"), kept.alias("kept_rows"), (rows - kept).alias("removed_rows")
    )


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns (all by default). NaN is not null."""
    condition = F.lit(True)
    for c in columns if columns is not None else df.columns:
        condition = condition & col(c).isNotNull()
    return df.where(condition)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows; nulls equal each other. Copies collapse before the shuffle."""
    if not any(types.has_map(f.dataType) for f in df.schema.fields):
        return df.dropDuplicates()
    n = fresh(df.columns, "n")  # grouping accepts maps, dropDuplicates does not
    return df.groupBy(*cols(df.columns)).agg(F.count(F.lit(1)).alias(n)).drop(n)


def _replace(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


# ---------------------------------------------------------------------------------------------
# type conversion


def cast_failures(df: DataFrame, targets: Mapping[str, str]) -> dict[str, int]:
    """Non-null values per column that the target type cannot hold, from one scan."""
    if not targets:
        return {}
    return one_row(
        df,
        {
            c: F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull())
            for c, t in targets.items()
        },
    )


def cast_columns(df: DataFrame, type_map: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast columns by a name -> type map; returns the frame and ``(column_name, target,
    outcome)`` rows.

    A column with any value that cannot be cast stays as it is (``failed``); so do unknown
    columns and types. Casting a fraction to an integer drops the fraction.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    targets, outcome = {}, {}
    for c, wanted in type_map.items():
        spark_type = types.CAST_TARGETS.get(wanted.lower())
        if c not in schema:
            outcome[c] = "column not found"
        elif spark_type is None:
            outcome[c] = "unknown type"
        elif not types.is_atomic(schema[c]) or not _castable(df, c, spark_type):
            outcome[c] = "failed"
        else:
            targets[c] = spark_type
    failures = cast_failures(df, targets)
    for c in targets:
        outcome[c] = "failed" if failures[c] else "converted"
    done = {c: col(c).cast(t) for c, t in targets.items() if not failures[c]}
    report = local_frame(
        df.sparkSession,
        [(c, type_map[c], outcome[c]) for c in type_map],
        "column_name string, target string, outcome string",
    )
    return _replace(df, done), report


def _castable(df: DataFrame, column: str, target: str) -> bool:
    """Whether the two types can be cast at all (a date to a number, for instance, cannot)."""
    try:
        df.select(col(column).cast(target))
    except Exception:  # the analyzer refuses the pair of types
        return False
    return True


# ---------------------------------------------------------------------------------------------
# missing values


def auto_strategies(df: DataFrame) -> dict[str, str]:
    """Mean for numeric columns, mode for all others."""
    numeric = set(types.numeric_columns(df))
    return {c: "fill_mean" if c in numeric else "fill_mode" for c in df.columns}


def expand_strategies(df: DataFrame, strategies: str | Mapping[str, str]) -> dict[str, str]:
    """Per-column strategies from a map, from a map with ``__all__``, or from one name for all."""
    if strategies == "auto":
        return auto_strategies(df)
    if isinstance(strategies, str):
        strategies = {"__all__": strategies}
    if "__all__" in strategies:
        strategies = {c: strategies["__all__"] for c in df.columns}
    return {c: s for c, s in strategies.items() if c in df.columns and s in STRATEGIES}


def fill_values(df: DataFrame, strategies: Mapping[str, str]) -> dict[str, Column]:
    """The fill literal of every column that has nulls and a usable strategy.

    One fused scan gives null counts and means; medians and modes follow only for columns that
    have nulls and need them.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    wanted = {
        c: s
        for c, s in strategies.items()
        if s != "drop" and isinstance(schema[c], T.DataType) and types.is_atomic(schema[c])
    }
    numeric = {c for c in wanted if types.is_numeric(schema[c])}
    exprs: dict = {"rows": F.count(F.lit(1))}
    for c, s in wanted.items():
        exprs[c, "nulls"] = F.count_if(col(c).isNull())
        if types.is_text(schema[c]) and s != "fill_zero" and s != "fill_empty":
            exprs[c, "longest"] = F.max(F.length(col(c)))
        if s == "fill_mean" and c in numeric:
            exprs[c, "mean"] = F.avg(finite(col(c).cast("double")))
    found = one_row(df, exprs)
    holes = {c: s for c, s in wanted.items() if found[c, "nulls"]}
    by_median = [c for c, s in holes.items() if s == "fill_median" and c in numeric]
    by_mode = [
        c
        for c, s in holes.items()
        if s == "fill_mode" or (s in ("fill_mean", "fill_median") and c not in numeric)
    ]
    medians = exact_quantiles(df, by_median, (0.5,))
    common = modes(df, by_mode, [c for c in by_mode if (found.get((c, "longest")) or 0) > LONG_TEXT])
    out: dict[str, Column] = {}
    for c, s in holes.items():
        if c in by_mode:
            if common[c] is not None:
                out[c] = F.lit(common[c]).cast(schema[c])
        elif c in by_median:
            if medians[c][0.5] is not None:
                out[c] = F.lit(medians[c][0.5])
        elif s == "fill_mean":
            if found[c, "mean"] is not None:
                out[c] = F.lit(found[c, "mean"])
        elif s == "fill_zero" and c in numeric:
            out[c] = F.lit(0).cast(schema[c])
        elif types.is_text(schema[c]):  # fill_zero and fill_empty
            out[c] = F.lit("")
    return out


def fill_missing(
    df: DataFrame, strategies: str | Mapping[str, str]
) -> tuple[DataFrame, list[str]]:
    """Handle nulls per column; returns the frame and the columns handled.

    ``drop`` columns come first, and the fill values are those of the surviving rows. Text falls
    back from mean and median to the mode. A mean or median turns an integer column into double;
    a column without nulls keeps its type. ``fill_empty`` touches text only.
    """
    strategies = expand_strategies(df, strategies)
    dropped = [c for c, s in strategies.items() if s == "drop"]
    if dropped:
        df = drop_nulls(df, dropped)
    fills = fill_values(df, strategies)
    schema = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for c, value in fills.items():
        widened = strategies[c] in ("fill_mean", "fill_median") and types.is_numeric(schema[c])
        changed[c] = F.coalesce(col(c).cast("double") if widened else col(c), value)
    return _replace(df, changed), dropped + list(fills)
