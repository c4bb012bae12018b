"""Cleaning queries: selection, conversion, deduplication, missing values, outliers, scaling."""

from __future__ import annotations

from prepkit.operators import cleaning as C
from prepkit.operators import encoding as E
from prepkit.operators import outliers as O
from queryset.common import (
    COLUMNS,
    DOCUMENTS_ROUGH,
    EVENTS_FINITE,
    EVENTS_NOT_FINITE,
    EVENTS_PAIR,
    LINEITEM_HOLES,
    LINEITEM_NUMBERS,
    ORDERS_DUPS,
    Frame,
    quantile_sql,
    read,
    rounded,
    union_sql,
)

# A text column that mostly holds numbers, one that always does, and fractions.
EVENTS_TEXT = Frame(
    "events",
    {
        "whole": "CAST(user_id AS STRING)",
        "mixed": "CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END",
        "signed": "CASE WHEN event_id % 2 = 0 THEN -value ELSE value END",
    },
    only=["event_id"],
)
DOCUMENTS_TEXT_HOLES = Frame(
    "documents", {"text": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END"}, only=["doc_id", "text"]
)
CAST_PLAN = {
    "whole": "int",
    "mixed": "int",
    "signed": "int32",
    "event_id": "string",
    "absent": "int",
}
EVENTS_HOLES = Frame(
    "events",
    {"value": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END", "square": "value * value"},
    only=["event_id", "value"],
)

_names = COLUMNS["lineitem"]
_holes = LINEITEM_HOLES.sql()
_filled = ("l_quantity", "l_discount", "l_returnflag")


def mode_sql(src: str, column: str) -> str:
    return (
        f"(SELECT {column} FROM {src} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def _fill_sql(src: str, fills: dict[str, str], columns=_names) -> str:
    items = ", ".join(
        f"round(coalesce({c}, {fills[c]}), 6) AS {c}"
        if c in fills and c not in ("l_returnflag", "c_mktsegment")
        else f"coalesce({c}, {fills[c]}) AS {c}"
        if c in fills
        else c
        for c in columns
    )
    return f"SELECT {items} FROM {src}"


def _mean(c: str) -> str:
    return f"(SELECT avg({c}) FROM {_holes})"


def _median(c: str) -> str:
    return f"(SELECT median({c}) FROM {_holes})"


def _fill(strategy):
    return lambda s, d: rounded(C.fill_missing(LINEITEM_HOLES.load(s, d), strategy)[0])


def bounds_sql(src: str, column: str, method: str = "iqr") -> str:
    if method == "iqr":
        q1, q3 = quantile_sql(column, 0.25), quantile_sql(column, 0.75)
        return f"SELECT {q1} - 1.5 * ({q3} - {q1}) AS lo, {q3} + 1.5 * ({q3} - {q1}) AS hi FROM {src}"
    return (
        f"SELECT avg({column}) - 3 * stddev_samp({column}) AS lo, "
        f"avg({column}) + 3 * stddev_samp({column}) AS hi FROM {src}"
    )


def outside_sql(src: str, columns, method="iqr", mode="sequential", drop_null=False) -> str:
    """A chain of CTEs ``r1, r2, ...``; the last one is the cleaned table."""
    steps, last = [f"r0 AS (SELECT * FROM {src})"], "r0"
    for i, c in enumerate(columns, start=1):
        basis = last if mode == "sequential" else "r0"
        keep = f"{c} BETWEEN b.lo AND b.hi" + ("" if drop_null else f" OR {c} IS NULL")
        keep = f"({keep})" + (f" OR b.lo = b.hi AND {str(method == 'zscore').lower()}")
        steps.append(
            f"r{i} AS (SELECT t.* FROM {last} t, ({bounds_sql(basis, c, method)}) b WHERE {keep})"
        )
        last = f"r{i}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT * FROM {last}"


def _capped_sql(src: str, columns, names, method: str) -> str:
    items = ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, b_{c}.lo), b_{c}.hi) END::DOUBLE, 6) AS {c}"
        if c in columns
        else c
        for c in names
    )
    bounds = ", ".join(f"({bounds_sql(src, c, method)}) b_{c}" for c in columns)
    return f"SELECT {items} FROM {src} t, {bounds}"


def _report_sql(src: str, columns) -> str:
    return union_sql(
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} < b.lo OR {c} > b.hi) AS outlier_count,
  round(max(b.lo), 6) AS lower_bound, round(max(b.hi), 6) AS upper_bound,
  round({quantile_sql(c, 0.25)}, 6) AS q1, round({quantile_sql(c, 0.75)}, 6) AS q3
FROM {src} t, ({bounds_sql(src, c)}) b"""
        for c in columns
    )


def _scaled_sql(src: str, numbers, names) -> str:
    items = ", ".join(
        f"({c}::DOUBLE - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE AS {c}"
        if c in numbers
        else c
        for c in names
    )
    return f"SELECT {items} FROM {src}"


def code_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN (dense_rank() OVER (ORDER BY {column} NULLS LAST) - 1)::INTEGER END"


def _numbers(table: str) -> list[str]:
    return {"events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"]}[table]


_pair = ["event_id", "a", "b"]
_eh = ["event_id", "value", "square"]

QUERIES = {
    "select_known_columns": lambda s, d: C.select_columns(
        read(s, d, "orders"), ["o_orderkey", "no_such_column", "o_totalprice"]
    ),
    "filter_categories": lambda s, d: C.filter_categories(
        read(s, d, "orders"), "o_orderstatus", ["F", "O"]
    ),
    "filter_categories_effect": lambda s, d: C.filter_effect(
        read(s, d, "documents"), "lang", ["en", "de"]
    ),
    "drop_nulls": lambda s, d: C.drop_nulls(
        LINEITEM_HOLES.load(s, d), ["l_quantity", "l_returnflag"]
    ),
    "drop_nulls_any_column": lambda s, d: C.drop_nulls(LINEITEM_HOLES.load(s, d)),
    "cast_columns": lambda s, d: C.cast_columns(EVENTS_TEXT.load(s, d), CAST_PLAN)[0],
    "cast_outcomes": lambda s, d: C.cast_columns(EVENTS_TEXT.load(s, d), CAST_PLAN)[1],
    "dedupe_rows": lambda s, d: C.remove_duplicates(ORDERS_DUPS.load(s, d)),
    "dedupe_documents": lambda s, d: C.remove_duplicates(DOCUMENTS_ROUGH.load(s, d)),
    "fill_mean": _fill("fill_mean"),
    "fill_median": _fill("fill_median"),
    "fill_mode": _fill("fill_mode"),
    "fill_mode_documents": lambda s, d: C.fill_missing(DOCUMENTS_TEXT_HOLES.load(s, d), "fill_mode")[0],
    "fill_zero": _fill("fill_zero"),
    "fill_empty": _fill("fill_empty"),
    "fill_map": _fill(
        {"l_quantity": "drop", "l_discount": "fill_median", "l_returnflag": "fill_mode"}
    ),
    "fill_auto": _fill("auto"),
    "outlier_report": lambda s, d: rounded(O.detect_outliers(read(s, d, "events"))),
    "outlier_report_holes": lambda s, d: rounded(O.detect_outliers(LINEITEM_HOLES.load(s, d))),
    "outliers_iqr_remove_sequential": lambda s, d: O.remove_outliers(EVENTS_PAIR.load(s, d)),
    "outliers_iqr_remove_joint": lambda s, d: O.remove_outliers(
        EVENTS_PAIR.load(s, d), mode="joint"
    ),
    "outliers_iqr_remove_documents": lambda s, d: O.remove_outliers(read(s, d, "documents")),
    "outliers_iqr_cap": lambda s, d: rounded(O.cap_outliers(EVENTS_HOLES.load(s, d))),
    "outliers_z_remove": lambda s, d: O.remove_outliers(EVENTS_PAIR.load(s, d), "zscore"),
    "outliers_z_cap": lambda s, d: rounded(O.cap_outliers(EVENTS_HOLES.load(s, d), "zscore")),
    "outliers_legacy_drop_null": lambda s, d: O.remove_outliers(
        EVENTS_HOLES.load(s, d), drop_null=True
    ),
    "outliers_legacy_z_drop_null": lambda s, d: O.remove_outliers(
        EVENTS_HOLES.load(s, d), "zscore", drop_null=True
    ),
    "normalize_minmax": lambda s, d: E.normalize(LINEITEM_HOLES.load(s, d)),
    "normalize_nan": lambda s, d: E.normalize(EVENTS_NOT_FINITE.load(s, d)).where("value <= 1"),
    "label_encode": lambda s, d: E.label_encode(DOCUMENTS_ROUGH.load(s, d)),
    "label_encode_part": lambda s, d: E.label_encode(read(s, d, "part")),
}

_mode = {c: mode_sql(_holes, c) for c in _filled}

ORACLES = {
    "select_known_columns": "SELECT o_orderkey, o_totalprice FROM orders",
    "filter_categories": "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "filter_categories_effect": """
SELECT count(*) AS original_rows, count(*) FILTER (lang IN ('en', 'de')) AS kept_rows,
  count(*) - count(*) FILTER (lang IN ('en', 'de')) AS removed_rows FROM documents""",
    "drop_nulls": f"SELECT * FROM {_holes} WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL",
    "drop_nulls_any_column": f"""
SELECT * FROM {_holes}
WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL AND l_discount IS NOT NULL""",
    "cast_columns": f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(whole AS BIGINT) AS whole, mixed,
  CAST(trunc(signed) AS INTEGER) AS signed
FROM {EVENTS_TEXT.sql().replace("STRING", "VARCHAR")}""",
    "cast_outcomes": f"""
SELECT 'whole' AS column_name, 'int' AS target, CASE WHEN count(*) FILTER (TRY_CAST(whole AS BIGINT) IS NULL) = 0
  THEN 'converted' ELSE 'failed' END AS outcome FROM {EVENTS_TEXT.sql().replace("STRING", "VARCHAR")}
UNION ALL SELECT 'mixed', 'int', CASE WHEN count(*) FILTER (TRY_CAST(mixed AS BIGINT) IS NULL) = 0
  THEN 'converted' ELSE 'failed' END FROM {EVENTS_TEXT.sql().replace("STRING", "VARCHAR")}
UNION ALL SELECT 'signed', 'int32', 'converted'
UNION ALL SELECT 'event_id', 'string', 'converted'
UNION ALL SELECT 'absent', 'int', 'column not found'""",
    "dedupe_rows": f"SELECT DISTINCT * FROM {ORDERS_DUPS.sql()}",
    "dedupe_documents": f"SELECT DISTINCT * FROM {DOCUMENTS_ROUGH.sql()}",
    "fill_mean": _fill_sql(
        _holes,
        {
            "l_quantity": _mean("l_quantity"),
            "l_discount": _mean("l_discount"),
            "l_returnflag": _mode["l_returnflag"],
        },
    ),
    "fill_median": _fill_sql(
        _holes,
        {
            "l_quantity": _median("l_quantity"),
            "l_discount": _median("l_discount"),
            "l_returnflag": _mode["l_returnflag"],
        },
    ),
    "fill_mode": _fill_sql(_holes, _mode),
    "fill_mode_documents": f"""
SELECT doc_id, coalesce(text, {mode_sql(DOCUMENTS_TEXT_HOLES.sql(), "text")}) AS text FROM {DOCUMENTS_TEXT_HOLES.sql()}""",
    "fill_zero": _fill_sql(_holes, {"l_quantity": "0", "l_discount": "0", "l_returnflag": "''"}),
    "fill_empty": _fill_sql(_holes, {"l_returnflag": "''"}),
    "fill_map": "WITH kept AS (SELECT * FROM "
    + _holes
    + " WHERE l_quantity IS NOT NULL) "
    + _fill_sql(
        "kept",
        {
            "l_discount": "(SELECT median(l_discount) FROM kept)",
            "l_returnflag": mode_sql("kept", "l_returnflag"),
        },
    ),
    "fill_auto": _fill_sql(
        _holes,
        {
            "l_quantity": _mean("l_quantity"),
            "l_discount": _mean("l_discount"),
            "l_returnflag": _mode["l_returnflag"],
        },
    ),
    "outlier_report": _report_sql("events", _numbers("events")),
    "outlier_report_holes": _report_sql(_holes, LINEITEM_NUMBERS),
    "outliers_iqr_remove_sequential": outside_sql(EVENTS_PAIR.sql(), _pair),
    "outliers_iqr_remove_joint": outside_sql(EVENTS_PAIR.sql(), _pair, mode="joint"),
    "outliers_iqr_remove_documents": outside_sql("documents", _numbers("documents")),
    "outliers_iqr_cap": _capped_sql(EVENTS_HOLES.sql(), _eh, _eh, "iqr"),
    "outliers_z_remove": outside_sql(EVENTS_PAIR.sql(), _pair, "zscore"),
    "outliers_z_cap": _capped_sql(EVENTS_HOLES.sql(), _eh, _eh, "zscore"),
    "outliers_legacy_drop_null": outside_sql(EVENTS_HOLES.sql(), _eh, drop_null=True),
    "outliers_legacy_z_drop_null": outside_sql(EVENTS_HOLES.sql(), _eh, "zscore", drop_null=True),
    "normalize_minmax": _scaled_sql(_holes, LINEITEM_NUMBERS, _names),
    "normalize_nan": f"""
SELECT (event_id::DOUBLE - lo) / (hi - lo) AS event_id, (value - (SELECT min(value) FROM {EVENTS_FINITE})) /
  ((SELECT max(value) FROM {EVENTS_FINITE}) - (SELECT min(value) FROM {EVENTS_FINITE})) AS value
FROM {EVENTS_FINITE}, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)""",
    "label_encode": f"""
SELECT doc_id, text, {code_sql("lang")} AS lang, {code_sql("source")} AS source, n_chars, flat
FROM {DOCUMENTS_ROUGH.sql()}""",
    "label_encode_part": f"""
SELECT p_partkey,
  CASE WHEN d.n_name <= 50 THEN ({code_sql("p_name")})::VARCHAR ELSE p_name END AS p_name,
  {code_sql("p_brand")} AS p_brand, {code_sql("p_type")} AS p_type, p_size, p_retailprice
FROM part, (SELECT count(DISTINCT p_name) AS n_name FROM part) d""",
}
