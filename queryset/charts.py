"""Chart-data queries: histograms, box, bar, scatter, correlation."""

from __future__ import annotations

from itertools import combinations, product

from prepkit.operators import charts as C
from prepkit.operators import correlation as R
from queryset.common import (
    DOCUMENTS_ROUGH,
    EVENTS_FINITE,
    EVENTS_LINE,
    EVENTS_NOT_FINITE,
    EVENTS_SIXTY,
    EVENTS_WIDE,
    LINEITEM_HOLES,
    LINEITEM_NUMBERS,
    order_hash_sql,
    quantile_sql,
    read,
    rounded,
    union_sql,
)


def _histogram_sql(src: str, column: str, bins: int) -> str:
    return f"""
WITH x AS (SELECT CAST({column} AS DOUBLE) AS x FROM {src} WHERE {column} IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN s.lo = s.hi THEN 0
        ELSE least(CAST(floor(CAST({bins} AS DOUBLE) * (x - s.lo) / (s.hi - s.lo)) AS INTEGER), {bins} - 1) END AS bucket
      FROM x, s)
SELECT bucket, round(s.lo + bucket * (s.hi - s.lo) / CAST({bins} AS DOUBLE), 6) AS bin_start,
  round(CASE WHEN s.lo = s.hi THEN s.hi ELSE s.lo + (bucket + 1) * (s.hi - s.lo) / CAST({bins} AS DOUBLE) END, 6) AS bin_end,
  count(*) AS n
FROM b, s GROUP BY bucket, s.lo, s.hi"""


def _box_sql(src: str, column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, min({column})::DOUBLE AS min, round({quantile_sql(column, 0.25)}, 6) AS q25,
  round({quantile_sql(column, 0.5)}, 6) AS median, round({quantile_sql(column, 0.75)}, 6) AS q75,
  max({column})::DOUBLE AS max, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std
FROM {src} WHERE {column} IS NOT NULL HAVING count(*) > 0"""


def _bar_sql(src: str, column: str) -> str:
    return f"""
SELECT CAST({column} AS VARCHAR) AS category, count(*) AS n FROM {src} WHERE {column} IS NOT NULL
GROUP BY {column} ORDER BY n DESC, {column} LIMIT 20"""


def _corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    flat = f"min({a}) FILTER ({both}) = max({a}) FILTER ({both}) OR min({b}) FILTER ({both}) = max({b}) FILTER ({both})"
    return f"CASE WHEN {flat} THEN 0.0 ELSE coalesce(corr({a}, {b}), 0.0) END"


def _matrix_sql(src: str, columns) -> str:
    return union_sql(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, 1.0::DOUBLE AS corr"
        if a == b
        else f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(({_corr(a, b)})::DOUBLE, 6) AS corr FROM {src}"
        for a, b in product(columns, columns)
    )


def _long_matrix_sql(src: str, columns) -> str:
    """The matrix of many columns: rows of (row, column, value) joined to themselves by row."""
    names = ", ".join(columns)
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)} FROM {src}),
long AS MATERIALIZED (UNPIVOT numbered ON {names} INTO NAME c VALUE x),
pairs AS (
  SELECT a.c AS col_i, b.c AS col_j, min(a.x) = max(a.x) OR min(b.x) = max(b.x) AS flat, corr(a.x, b.x) AS r
  FROM long a JOIN long b ON a.r = b.r WHERE a.c < b.c GROUP BY a.c, b.c
), found AS (
  SELECT col_i, col_j, CASE WHEN flat THEN 0.0 ELSE coalesce(r, 0.0) END AS corr FROM pairs
)
SELECT col_i, col_j, round(corr, 6) AS corr FROM found
UNION ALL SELECT col_j, col_i, round(corr, 6) FROM found
UNION ALL SELECT unnest([{", ".join(f"'{c}'" for c in columns)}]) AS c, c, 1.0"""


def _pairs_sql(src: str, columns) -> str:
    parts = union_sql(
        f"SELECT '{a}' AS col_1, '{b}' AS col_2, ({_corr(a, b)})::DOUBLE AS r FROM {src}"
        for a, b in combinations(columns, 2)
    )
    return f"SELECT col_1, col_2, round(r, 3) AS corr FROM ({parts}) WHERE abs(r) > 0.95"


def _scatter_sql(src: str, x: str, y: str, limit: int, *keys: str) -> str:
    return f"""
SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src}
WHERE {x} IS NOT NULL AND {y} IS NOT NULL
ORDER BY {order_hash_sql(*keys)}, x, y LIMIT {limit}"""


_line = EVENTS_LINE.sql()
_holes = LINEITEM_HOLES.sql()

QUERIES = {
    "histogram_events_value": lambda s, d: rounded(C.histogram(read(s, d, "events"), "value")),
    "histogram_most_bins": lambda s, d: rounded(
        C.histogram(read(s, d, "lineitem"), "l_extendedprice", 500)
    ),
    "histogram_with_nulls": lambda s, d: rounded(
        C.histogram(LINEITEM_HOLES.load(s, d), "l_quantity", 10)
    ),
    "histogram_constant": lambda s, d: rounded(C.histogram(EVENTS_LINE.load(s, d), "k")),
    "chart_bars_of_numbers": lambda s, d: rounded(
        C.column_chart(read(s, d, "part"), "p_size", "bar", 20)
    ),
    "histogram_nan": lambda s, d: rounded(C.histogram(EVENTS_NOT_FINITE.load(s, d), "value")),
    "histogram_statistics": lambda s, d: rounded(
        C.histogram_statistics(LINEITEM_HOLES.load(s, d), "l_quantity")
    ),
    "bar_documents_text": lambda s, d: C.bar(DOCUMENTS_ROUGH.load(s, d), "text"),
    "correlation_wide": lambda s, d: rounded(R.correlation_matrix(EVENTS_WIDE.load(s, d))),
    "box_n_chars": lambda s, d: rounded(C.box(read(s, d, "documents"), "n_chars")),
    "box_with_nulls": lambda s, d: rounded(C.box(LINEITEM_HOLES.load(s, d), "l_discount")),
    "bar_documents_source": lambda s, d: C.column_chart(read(s, d, "documents"), "source"),
    "bar_part_type": lambda s, d: C.bar(read(s, d, "part"), "p_type"),
    "bar_dates": lambda s, d: C.bar(
        read(s, d, "orders").selectExpr("cast(o_orderdate as date) AS day"), "day"
    ),
    "scatter_events": lambda s, d: C.scatter(
        read(s, d, "events"), "user_id", "value", 500, ["event_id"]
    ),
    "scatter_most_rows": lambda s, d: C.scatter(
        read(s, d, "orders"), "o_custkey", "o_totalprice", 9999, ["o_orderkey"]
    ),
    "correlation_sixty_columns": lambda s, d: rounded(R.correlation_matrix(EVENTS_SIXTY.load(s, d))),
    "correlation_matrix": lambda s, d: rounded(R.correlation_matrix(read(s, d, "lineitem"))),
    "correlation_with_nulls": lambda s, d: rounded(
        R.correlation_matrix(LINEITEM_HOLES.load(s, d))
    ),
    "correlation_of_constants": lambda s, d: rounded(R.correlation_matrix(EVENTS_LINE.load(s, d))),
    "correlated_pairs": lambda s, d: R.correlated_pairs(EVENTS_LINE.load(s, d)),
}

ORACLES = {
    "histogram_events_value": _histogram_sql("events", "value", 15),
    "histogram_most_bins": _histogram_sql("lineitem", "l_extendedprice", 500),
    "histogram_with_nulls": _histogram_sql(_holes, "l_quantity", 10),
    "histogram_constant": _histogram_sql(_line, "k", 15),
    "chart_bars_of_numbers": _histogram_sql("part", "p_size", 20),
    "histogram_nan": _histogram_sql(EVENTS_FINITE, "value", 15),
    "histogram_statistics": f"""
SELECT b.*, (SELECT count(l_quantity) FROM {_holes}) AS non_null FROM ({_box_sql(_holes, "l_quantity")}) b""",
    "bar_documents_text": _bar_sql(DOCUMENTS_ROUGH.sql(), "text"),
    "correlation_wide": _matrix_sql(EVENTS_WIDE.sql(), EVENTS_WIDE.columns),
    "box_n_chars": _box_sql("documents", "n_chars"),
    "box_with_nulls": _box_sql(_holes, "l_discount"),
    "bar_documents_source": _bar_sql("documents", "source"),
    "bar_part_type": _bar_sql("part", "p_type"),
    "bar_dates": _bar_sql("(SELECT CAST(o_orderdate AS DATE) AS day FROM orders)", "day"),
    "scatter_events": _scatter_sql("events", "user_id", "value", 500, "event_id"),
    "scatter_most_rows": _scatter_sql("orders", "o_custkey", "o_totalprice", 9999, "o_orderkey"),
    "correlation_sixty_columns": _long_matrix_sql(EVENTS_SIXTY.sql(), EVENTS_SIXTY.columns),
    "correlation_matrix": _matrix_sql("lineitem", LINEITEM_NUMBERS),
    "correlation_with_nulls": _matrix_sql(_holes, LINEITEM_NUMBERS),
    "correlation_of_constants": _matrix_sql(_line, ["event_id", "a", "b", "c", "k"]),
    "correlated_pairs": _pairs_sql(_line, ["a", "b", "c", "k"]),
}
