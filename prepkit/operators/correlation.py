"""Pearson correlation of all column pairs from two scans: fused sums, or one Gramian for wide tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import col, name_matches
from prepkit.operators.aggregates import AGG_WIDTH, local_frame, one_row

# A spread below this share of the squared size is rounding noise: the column is constant.
_NOISE = 1e-13


def _spread(squares: float, total: float, n: int) -> float:
    spread = squares - total * total / n
    return spread if spread > _NOISE * squares else 0.0


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Correlation per column pair over the rows where both are non-null; None where undefined.

    The first scan finds the means, the second sums products of centred values: plain sums, which
    stay in generated code, against six buffers per pair for the built-in ``corr``. Columns
    without nulls share their own sums; only pairs with a null column need sums of their own. Where
    the pairs need more than ``AGG_WIDTH`` sums, one matrix product has them all.
    """
    columns = list(columns)
    if len(columns) < 2:
        return {}
    first: dict = {"rows": F.count(F.lit(1))}
    for c in columns:
        first[c, "n"] = F.count(col(c))
        first[c, "mean"] = F.avg(col(c).cast("double"))
    known = one_row(df, first)
    full = {c for c in columns if known[c, "n"] == known["rows"]}
    # values that are not finite leave every correlation of their column undefined
    usable = [c for c in columns if known[c, "n"] > 0 and math.isfinite(known[c, "mean"])]
    means = {c: known[c, "mean"] for c in usable}
    sums = len(usable) * (len(usable) - 1) // 2 * (1 if full.issuperset(usable) else 6)
    found = (_gramian_sums if sums > AGG_WIDTH else _fused_sums)(df, usable, means, full)
    out: dict[tuple[str, str], float | None] = {p: None for p in combinations(columns, 2)}
    for a, b in combinations(usable, 2):
        n, sx, sy, sxx, syy, sxy = found(a, b)
        if not n:
            continue
        spread = _spread(sxx, sx, n) * _spread(syy, sy, n)
        if spread > 0 and math.isfinite(spread):
            r = (sxy - sx * sy / n) / math.sqrt(spread)
            out[a, b] = max(-1.0, min(1.0, r))
    return out


def _fused_sums(df: DataFrame, columns: list[str], means: dict[str, float], full: set[str]) -> Callable:
    """Sums by pair of columns, as plain aggregates: for few columns, in generated code."""

    def centred(c: str) -> Column:
        return col(c).cast("double") - F.lit(means[c])

    sums: dict = {"rows": F.count(F.lit(1))}
    for c in columns:
        if c in full:
            sums[c, "sum"], sums[c, "square"] = F.sum(centred(c)), F.sum(centred(c) * centred(c))
    for a, b in combinations(columns, 2):
        x, y = centred(a), centred(b)
        sums[a, b, "xy"] = F.sum(x * y)
        if a in full and b in full:
            continue
        both = x.isNotNull() & y.isNotNull()
        sums[a, b, "n"] = F.count_if(both)
        for key, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y)):
            sums[a, b, key] = F.sum(F.when(both, v))
    found = one_row(df, sums)

    def of(a: str, b: str) -> tuple:
        if a in full and b in full:
            return (found["rows"], *(found[k] for k in ((a, "sum"), (b, "sum"), (a, "square"), (b, "square"), (a, b, "xy"))))
        return tuple(found[a, b, k] for k in ("n", "x", "y", "xx", "yy", "xy"))

    return of


def _gramian_sums(df: DataFrame, columns: list[str], means: dict[str, float], full: set[str]) -> Callable:
    """The same sums for any number of columns from one matrix product, in one scan.

    With m = 1 where a value is there and x its centred value (else both 0), the Gramian of the rows
    ``[1, x of all columns, x^2 of all columns, m of the columns with nulls]`` holds the counts, sums,
    squares and products of all pairs over the rows where both are there. Partial products are summed
    by tree on the executors; the driver gets one number for each pair of entries.
    """
    x = {c: F.coalesce(col(c).cast("double") - F.lit(means[c]), F.lit(0.0)) for c in columns}
    entries: dict = {"one": F.lit(1.0)} | {(c, "x"): x[c] for c in columns}
    if not full.issuperset(columns):
        entries |= {(c, "xx"): x[c] * x[c] for c in columns}
        entries |= {(c, "there"): col(c).isNotNull().cast("double") for c in columns if c not in full}
    rows = df.select(array_to_vector(F.array(*entries.values())).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), numCols=len(entries))
    product = matrix.computeGramianMatrix().toArray()
    at = {name: i for i, name in enumerate(entries)}

    def of(a: str, b: str) -> tuple:
        x, y, there, too = at[a, "x"], at[b, "x"], at.get((a, "there"), 0), at.get((b, "there"), 0)
        xx = product[at[a, "xx"], too] if (a, "xx") in at else product[x, x]
        yy = product[at[b, "xx"], there] if (b, "xx") in at else product[y, y]
        return round(product[there, too]), product[x, too], product[y, there], xx, yy, product[x, y]

    return of


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_i, col_j, corr)`` of the numeric columns (or of those given), all ordered pairs.

    The diagonal is 1; a pair without a defined correlation is 0. Fewer than two numeric columns
    give no rows.
    """
    columns = types.numeric_columns(df) if columns is None else list(columns)
    found = pair_correlations(df, columns)
    rows = []
    if len(columns) > 1:
        rows = [(c, c, 1.0) for c in columns]
        for (a, b), r in found.items():
            rows += [(a, b, r or 0.0), (b, a, r or 0.0)]
    return local_frame(df.sparkSession, rows, "col_i string, col_j string, corr double")


def correlated_pairs(
    df: DataFrame, threshold: float = K.HIGH_CORRELATION
) -> DataFrame:
    """``(col_1, col_2, corr)`` with \\|r\\| above 0.95 among the numeric columns that are not named
    like identifiers; 3 decimals."""
    columns = [
        c for c in types.numeric_columns(df) if not name_matches(c, K.ID_KEYWORDS, "suffix")
    ]
    rows = [
        (a, b, round(r, 3))
        for (a, b), r in pair_correlations(df, columns).items()
        if r is not None and abs(r) > threshold
    ]
    return local_frame(df.sparkSession, rows, "col_1 string, col_2 string, corr double")
