"""Profiling: what is in a table, as metric rows.

Every report is a DataFrame with one row per column, per column value or per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import col, compact_text, percent, rounded, union_all
from prepkit.operators.aggregates import (
    distinct_counts,
    few_valued,
    local_frame,
    per_column,
    rank_columns,
    summary,
    value_counts,
)


def table_shape(df: DataFrame) -> DataFrame:
    """``(row_count, column_count)``."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def schema_rows(df: DataFrame) -> DataFrame:
    """``(ordinal, column_name, data_type, role)`` from the schema alone."""
    rows = [
        (i, f.name, f.dataType.simpleString(), types.role(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return local_frame(
        df.sparkSession, rows, "ordinal int, column_name string, data_type string, role string"
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, ordinal, row_count, null_count)`` from one fused scan."""
    return per_column(
        df,
        df.columns if columns is None else columns,
        lambda c: {"row_count": F.count(F.lit(1)), "null_count": F.count_if(col(c).isNull())},
    )


def column_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Null and distinct counts: ``(column_name, ordinal, row_count, null_count, null_pct,
    distinct_count)``. Distinct counts leave null out and are exact unless ``approx``."""
    columns = list(df.columns if columns is None else columns)
    distinct = distinct_counts(df, columns, approx)
    return (
        null_counts(df, columns)
        .join(F.broadcast(distinct), "column_name", "left")  # one row per column at most
        .select(
            "column_name",
            "ordinal",
            "row_count",
            "null_count",
            percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        )
    )


NUMERIC_SCHEMA = (
    "column_name string, non_null bigint, mean double, median double, std double, "
    "min double, max double, q25 double, q75 double"
)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, sample deviation, extremes and quartiles of the numeric columns.

    All of them describe the finite values; ``non_null`` counts NaN and infinities, too.

    Runs when it is called, as ``approxQuantile`` does: one fused scan, then the exact quantiles.
    """
    return numeric_profile(df, columns, distinct=False).select(
        *[f.split()[0] for f in NUMERIC_SCHEMA.split(", ")]
    )


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: bool = True
) -> DataFrame:
    """:func:`numeric_summary` with ``row_count``, ``null_count``, ``null_pct`` and exact
    ``distinct_count`` (null unless ``distinct``).

    Ranking the values for the quartiles also counts them; only columns too wide to be ranked
    whole, or not exact as doubles, are counted by a job of their own.
    """
    columns = list(types.numeric_columns(df) if columns is None else columns)
    stats = summary(df, columns)
    counts = {c: s["finite"] for c, s in stats.items()}
    quantiles, ranked = rank_columns(df, columns, (0.25, 0.5, 0.75), counts=counts)
    known = {c: d for c, d in ranked.items() if _exact_as_double(df, c, stats[c])}
    if distinct:
        rest = [c for c in columns if c not in known and stats[c]["count"]]
        if rest:  # one row per column
            found = distinct_counts(df, rest).collect()
            known |= {r["column_name"]: r["distinct_count"] for r in found}
    rows = []
    for c in columns:
        s, q = stats[c], quantiles[c]
        nulls = s["rows"] - s["count"]
        rows.append(
            (c, s["count"], s["mean"], q[0.5], s["std"], s["min"], s["max"], q[0.25], q[0.75])
            + (s["rows"], nulls, known.get(c, 0) if distinct else None)
        )
    frame = local_frame(
        df.sparkSession,
        rows,
        NUMERIC_SCHEMA + ", row_count bigint, null_count bigint, distinct_count bigint",
    )
    return frame.withColumn("null_pct", percent(F.col("null_count"), F.col("row_count")))


def _exact_as_double(df: DataFrame, column: str, stats: Mapping) -> bool:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType) or stats["finite"] != stats["count"]:
        return False
    if isinstance(kind, T.LongType):
        return max(abs(stats["min"]), abs(stats["max"])) <= 2**53
    return True


def is_categorical(distinct: Column, rows: Column) -> Column:
    return distinct < F.least(rows * F.lit(K.CATEGORICAL_SHARE), F.lit(float(K.CATEGORICAL_MAX)))


def categorical_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, ordinal, row_count, distinct_count, is_categorical)`` of the text columns
    (or of those given); no row for a table without text.

    Categorical means fewer distinct values than 20 % of the rows and fewer than 50.
    """
    return column_counts(df, types.text_columns(df) if columns is None else columns).select(
        "column_name",
        "ordinal",
        "row_count",
        "distinct_count",
        is_categorical(F.col("distinct_count"), F.col("row_count")).alias("is_categorical"),
    )


def top_values(df: DataFrame, limit: int | None = K.TOP_VALUES) -> DataFrame:
    """The most frequent values of every categorical column: ``(column_name, value, n, pct,
    rank)``, ``pct`` of all rows. Ties go to the smaller value; without ``limit`` all values.

    A cheap sketch first rules out the columns that cannot be categorical, so free text is
    neither counted nor shuffled.
    """
    columns = few_valued(df, types.text_columns(df))
    if not columns:
        return local_frame(
            df.sparkSession, [], "column_name string, value string, n bigint, pct double, rank int"
        )
    counted = value_counts(df, columns)[0][1]
    total = df.agg(F.count(F.lit(1))).scalar()
    by_column = Window.partitionBy("column_name")  # a few dozen values per column
    order = by_column.orderBy(F.desc("n"), F.asc("value"))
    return (
        counted.withColumn("distinct_count", F.count(F.lit(1)).over(by_column))
        .withColumn("rank", F.row_number().over(order))
        .where(is_categorical(F.col("distinct_count"), total))
        .where(F.lit(True) if limit is None else F.col("rank") <= limit)
        .select("column_name", "value", "n", percent(F.col("n"), total).alias("pct"), "rank")
    )


def severity(ratio: Column, notice: bool = False) -> Column:
    """SEVERE above 10, WARNING above 3, NOTICE above 1.5 (where asked for), else null."""
    tier = F.when(ratio > K.SEVERE_RATIO, "SEVERE").when(ratio > K.WARNING_RATIO, "WARNING")
    return tier.when(ratio > K.NOTICE_RATIO, "NOTICE") if notice else tier


def imbalance_warnings(df: DataFrame) -> DataFrame:
    """``(column_name, ratio, severity)`` of categorical columns whose values are uneven.

    The ratio is that of the most to the least frequent of all values of the column.
    """
    ratio = F.max("n") / F.min("n")
    return (
        top_values(df, None)
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("values"), ratio.alias("ratio"))
        .where((F.col("values") >= 2) & (F.col("ratio") > K.WARNING_RATIO))
        .select("column_name", rounded(F.col("ratio"), 2).alias("ratio"), severity(F.col("ratio")).alias("severity"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(row_count, distinct_rows, duplicate_rows)``; nulls equal each other.

    Copies collapse before the shuffle, and long strings travel as their SHA-256, so neither a
    huge group of copies nor whole documents cross the network.
    """
    keys = [
        (compact_text(col(f.name).cast("string")) if types.is_text(f.dataType) else col(f.name)).alias(f"k{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """``(row_count, missing_cells, cells)`` of the whole table, from one fused scan."""
    counts = null_counts(df)
    return counts.agg(
        F.max("row_count").alias("row_count"),
        F.sum("null_count").alias("missing_cells"),
        F.sum("row_count").alias("cells"),
    )


def missing_rate(df: DataFrame) -> DataFrame:
    """``(row_count, missing_cells, cells, missing_rate)``; 0 for an empty table."""
    rate = F.coalesce(F.try_divide(F.col("missing_cells"), F.col("cells")), F.lit(0.0))
    return missing_cells(df).withColumn("missing_rate", rounded(rate, 6))


def most_missing(df: DataFrame, limit: int = 3) -> DataFrame:
    """The columns with the highest null share: ``(column_name, ordinal, null_count, null_pct)``."""
    return (
        null_counts(df)
        .select(
            "column_name",
            "ordinal",
            "null_count",
            percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
        )
        .orderBy(F.desc_nulls_last("null_pct"), "ordinal")
        .limit(limit)
    )


def quality_score(df: DataFrame) -> DataFrame:
    """``(row_count, missing_cells, duplicate_rows, quality_score)``: 100 less 30 times the share
    of missing cells less 20 times the share of duplicate rows, within 0..100; 0 when empty."""
    duplicates = duplicate_rows(df).select("duplicate_rows").scalar()
    score = (
        F.lit(100.0)
        - F.try_divide(F.col("missing_cells") * 30.0, F.col("cells"))
        - F.try_divide(F.col("duplicate_rows") * 20.0, F.col("row_count"))
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded(score, 2)))
    return (
        missing_cells(df)
        .withColumn("duplicate_rows", duplicates)
        .select(
            "row_count",
            "missing_cells",
            "duplicate_rows",
            F.when(F.col("row_count") > 0, clamped).otherwise(0.0).alias("quality_score"),
        )
    )


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """``(class, n, pct)`` with the null class; ``pct`` of all rows."""
    counts = df.groupBy(col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("class", "n", percent(F.col("n"), total).alias("pct"))


def class_imbalance(df: DataFrame, column: str) -> DataFrame:
    """``(total, classes, ratio, is_imbalanced, severity)`` of one column, null class included."""
    counts = df.groupBy(col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.try_divide(F.max("n"), F.min("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("classes"),
        ratio.alias("ratio"),
    ).select(
        "total",
        "classes",
        rounded(F.col("ratio"), 2).alias("ratio"),
        (F.col("ratio") > K.NOTICE_RATIO).alias("is_imbalanced"),
        severity(F.col("ratio"), notice=True).alias("severity"),
    )


def null_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(column_name, nulls_before, nulls_after)``; a side without the column is null."""
    old = null_counts(before).select("column_name", F.col("null_count").alias("nulls_before"))
    new = null_counts(after).select("column_name", F.col("null_count").alias("nulls_after"))
    return old.join(new, "column_name", "full")


def fleet_profiles(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``(table_name, row_count, column_count, status)``.

    The status is PROFILED or EMPTY; a caller that keeps a catalog sets CLEANED for tables that
    were cleaned, and adds their size as ``bytes`` (see ``dataset_size``).
    """
    frames = [
        table_shape(df).select(
            F.lit(name).alias("table_name"),
            "row_count",
            "column_count",
            F.when(F.col("row_count") > 0, "PROFILED").otherwise("EMPTY").alias("status"),
        )
        for name, df in tables.items()
    ]
    return union_all(frames)


def fleet_totals(profiles: DataFrame) -> DataFrame:
    """Grand totals over profile rows: tables, rows, columns, the number per status (a cleaned
    table was profiled before), and the sum of ``bytes`` where the rows have sizes."""
    size = F.col("bytes") if "bytes" in profiles.columns else F.lit(None).cast("bigint")
    return profiles.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("row_count").alias("total_rows"),
        F.sum("column_count").alias("total_columns"),
        F.sum(size).cast("bigint").alias("total_bytes"),
        F.count_if(F.col("status").isin("PROFILED", "CLEANED")).alias("profiled"),
        F.count_if(F.col("status") == "CLEANED").alias("cleaned"),
        F.count_if(F.col("status") == "EMPTY").alias("empty"),
    )
