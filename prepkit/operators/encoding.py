"""Min-max scaling and label encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import col, finite
from prepkit.operators.aggregates import few_valued, one_row, value_counts


def scaling_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple]:
    """Minimum and maximum of the finite values of the numeric columns that have two or more, in
    one pass."""
    names = list(columns) if columns is not None else types.numeric_columns(df)
    exprs: dict = {}
    for c in names:
        exprs[c, "lo"], exprs[c, "hi"] = (f(finite(col(c).cast("double"))) for f in (F.min, F.max))
    found = one_row(df, exprs) if exprs else {}
    pairs = {c: (found[c, "lo"], found[c, "hi"]) for c in names}
    return {c: p for c, p in pairs.items() if p[0] is not None and p[0] != p[1]}


def scale(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Apply ranges found by :func:`scaling_ranges` (of this frame or of a training frame)."""

    def scaled(c: str) -> Column:
        lo, hi = ranges[c]
        return ((col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)).alias(c)

    return df.select(*[scaled(c) if c in ranges else col(c) for c in df.columns])


def normalize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns scaled to [0, 1]; constant and all-null columns stay as they are.

    NaN and infinities stay what they are and do not count for the range.
    """
    return scale(df, scaling_ranges(df, columns))


def label_dictionaries(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = K.ENCODE_MAX
) -> dict[str, list[str]]:
    """The sorted values of the text columns with at most ``limit`` distinct ones, null included.

    A sketch rules out wide columns first; what is counted and collected after that is a few
    dozen values per column.
    """
    names = list(columns) if columns is not None else types.text_columns(df)
    names = [c for c in names if types.is_text(df.schema[c].dataType)]
    has_null: dict[str, bool] = {}
    names = few_valued(df, names, limit, has_null)
    if not names:
        return {}
    if not has_null:
        has_null = one_row(df, {c: F.count_if(col(c).isNull()) > 0 for c in names})
    counted = value_counts(df, names)[0][1]
    per_name = counted.groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("v"))
    values = {r["column_name"]: list(r["v"]) for r in per_name.collect()}
    out = {}
    for c in names:
        found = values.get(c, [])
        if len(found) + bool(has_null[c]) <= limit:
            out[c] = found
    return out


def encode(df: DataFrame, dictionaries: dict[str, list[str]]) -> DataFrame:
    """Replace values by their 0-based place in the dictionary; null and unknown become null."""

    def code(c: str) -> Column:
        values = dictionaries[c]
        if not values:
            return F.lit(None).cast("int").alias(c)
        table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
        return F.element_at(table, col(c)).alias(c)

    return df.select(*[code(c) if c in dictionaries else col(c) for c in df.columns])


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Integer codes for the text columns with at most 50 values, in alphabetical order."""
    return encode(df, label_dictionaries(df, columns))
