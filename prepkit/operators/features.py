"""Feature and target suggestions, and the features they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import col, name_matches
from prepkit.operators.aggregates import (
    distinct_counts,
    few_valued,
    local_frame,
    one_row,
    value_counts,
)
from prepkit.operators.correlation import correlated_pairs
from prepkit.operators.profile import categorical_flags

NORMALIZE_RANGE = 100
DROP_SHARE = 0.9
TARGET_VALUES = (2, 20)


def text_length(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the length of a text column in characters; null for null."""
    return df.withColumn(name or f"{column}_length", F.length(col(column)))


def hash_bucket_of(value: Column, buckets: int) -> Column:
    """A stable bucket number in 0..buckets-1 for any string; null for null."""
    return F.pmod(
        F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint"),
        F.lit(buckets),
    )


def hash_encode(df: DataFrame, column: str, buckets: int = 64, name: str | None = None) -> DataFrame:
    """Add a hash code of a high-cardinality column; needs no dictionary and no extra pass."""
    return df.withColumn(name or f"{column}_hash", hash_bucket_of(col(column), buckets))


def feature_suggestions(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(column_name, suggestion, detail)`` rows.

    ``drop``: named like an identifier, or text with distinct values above 90 % of the rows (then
    also ``length_feature``). ``normalize``: numeric with a range above 100. ``encode``: text with
    at most 50 values. ``hash_encoding``: other text. ``correlated``: strongly correlated pairs,
    the second column in ``detail``. With ``approx`` wide text columns are counted by a sketch.
    """
    ids = [c for c in df.columns if name_matches(c, K.ID_KEYWORDS, "suffix")]
    others = [f for f in df.schema.fields if f.name not in ids]
    numeric = [f.name for f in others if types.is_numeric(f.dataType)]
    text = [f.name for f in others if types.is_text(f.dataType)]
    exprs: dict = {"rows": F.count(F.lit(1))}
    for c in numeric:
        x = col(c).cast("double")
        exprs[c] = F.max(x) - F.min(x)
    found = one_row(df, exprs)
    distinct = {c: 0 for c in text}
    if text:
        for r in distinct_counts(df, text, approx).collect():  # one row per text column
            distinct[r["column_name"]] = r["distinct_count"]
    rows: list[tuple] = [(c, "drop", None) for c in ids]
    rows += [(c, "normalize", None) for c in numeric if (found[c] or 0) > NORMALIZE_RANGE]
    for c in text:
        if distinct[c] / max(found["rows"], 1) > DROP_SHARE:
            rows += [(c, "drop", None), (c, "length_feature", None)]
        else:
            wide = distinct[c] > K.ENCODE_MAX
            rows.append((c, "hash_encoding" if wide else "encode", None))
    suggested = local_frame(
        df.sparkSession, rows, "column_name string, suggestion string, detail string"
    )
    pairs = correlated_pairs(df).select(
        F.col("col_1").alias("column_name"),
        F.lit("correlated").alias("suggestion"),
        F.col("col_2").alias("detail"),
    )
    return suggested.unionByName(pairs)


def _is_target_name(name: str, strict: bool) -> bool:
    if not strict:
        return name_matches(name, K.TARGET_KEYWORDS, "edges")
    words = [w.strip("_") for w in K.TARGET_KEYWORDS]
    parts = name.lower().split("_")
    return parts[0] in words or parts[-1] in words


def target_columns(
    df: DataFrame, strict_keywords: bool = False, limit: int | None = None
) -> DataFrame:
    """``(rank, column_name)``: likely targets in column order, the first ``limit`` if given.

    A column qualifies by its name (a keyword at either end) or, for text and integers, by having
    2 to 19 distinct values. ``strict_keywords`` wants the keyword as a whole ``_`` part, as the
    one-letter keyword otherwise matches every name that ends in it.
    """
    named = [c for c in df.columns if _is_target_name(c, strict_keywords)]
    counted = [
        f.name
        for f in df.schema.fields
        if f.name not in named and (types.is_text(f.dataType) or types.is_integer(f.dataType))
    ]
    low, high = TARGET_VALUES
    few: set[str] = set()
    for _, frame in value_counts(df, few_valued(df, counted)):
        per_name = frame.groupBy("column_name").agg(F.count(F.lit(1)).alias("d"))
        hits = per_name.where((F.col("d") >= low) & (F.col("d") < high))
        few |= {r["column_name"] for r in hits.collect()}
    found = [c for c in df.columns if c in named or c in few][:limit]
    return local_frame(
        df.sparkSession,
        [(i + 1, c) for i, c in enumerate(found)],
        "rank int, column_name string",
    )


def category_targets(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``(rank, column_name)``: columns hinting at a target by name, or categorical with 2 to 49
    values, in column order; the first ``limit`` if given.

    A sketch first rules out the columns with more values, so free text is not counted.
    """
    hinted = [c for c in df.columns if name_matches(c, K.TARGET_HINTS, "inside")]
    few: set[str] = set()
    rest = few_valued(df, [c for c in types.text_columns(df) if c not in hinted])
    if rest:
        flags = categorical_flags(df, rest).where("is_categorical and distinct_count between 2 and 49")
        few = {r["column_name"] for r in flags.collect()}
    found = [c for c in df.columns if c in hinted or c in few][:limit]
    return local_frame(
        df.sparkSession,
        [(i + 1, c) for i, c in enumerate(found)],
        "rank int, column_name string",
    )
