"""Profile queries: shape, nulls, distincts, numeric summaries, categories, duplicates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepkit import profile_table
from prepkit.operators import profile as P
from queryset.common import (
    COLUMNS,
    CUSTOMER_ROUGH,
    DOCUMENTS_ROUGH,
    LINEITEM_HOLES,
    LINEITEM_NUMBERS,
    ORDERS_DUPS,
    ORDERS_RARE,
    TABLES,
    quantile_sql,
    read,
    role_of,
    rounded,
    union_sql,
)

NUMBERS = "mean median std min max q25 q75".split()


def _counts_sql(src: str, columns, distinct: bool = True) -> str:
    parts = []
    for i, c in enumerate(columns):
        extra = ""
        if distinct:
            extra = (
                f", round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_pct, "
                f"count(DISTINCT {c}) AS distinct_count"
            )
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, count(*) AS row_count, "
            f"count(*) - count({c}) AS null_count{extra} FROM {src}"
        )
    return union_sql(parts)


def _numeric_sql(src: str, columns) -> str:
    return union_sql(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, round(avg({c}), 6) AS mean, "
        f"round({quantile_sql(c, 0.5)}, 6) AS median, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, "
        f"round({quantile_sql(c, 0.25)}, 6) AS q25, round({quantile_sql(c, 0.75)}, 6) AS q75 "
        f"FROM {src}"
        for c in columns
    )


def _joined_sql(src: str, columns, names) -> str:
    return (
        f"SELECT n.*, c.row_count, c.null_count, c.null_pct, c.distinct_count FROM "
        f"({_numeric_sql(src, columns)}) n JOIN ({_counts_sql(src, names)}) c USING (column_name)"
    )


def _whole_profile(spark, d):
    out = profile_table(LINEITEM_HOLES.load(spark, d)).columns()
    return rounded(out.drop("data_type", "non_null"))


def _whole_profile_sql() -> str:
    src, columns = LINEITEM_HOLES.sql(), COLUMNS["lineitem"]
    roles = ", ".join(f"('{c}', '{role_of(c)}')" for c in columns)
    return f"""
SELECT c.*, r.role,
  CASE r.role WHEN 'numeric' THEN false
              WHEN 'text' THEN c.distinct_count < least(c.row_count * 0.2::DOUBLE, 50) END AS is_categorical,
  {", ".join("n." + x for x in NUMBERS)}
FROM ({_counts_sql(src, columns)}) c
JOIN (VALUES {roles}) r(column_name, role) USING (column_name)
LEFT JOIN ({_numeric_sql(src, LINEITEM_NUMBERS)}) n USING (column_name)"""


def _top_sql(src: str, columns, limit: int | None = 20) -> str:
    counted = union_sql(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, "
        f"(SELECT count(*) FROM {src}) AS total FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )
    return f"""
SELECT column_name, value, n, round(n * 100.0 / total, 2)::DOUBLE AS pct, rank::INTEGER AS rank FROM (
  SELECT *, count(*) OVER (PARTITION BY column_name) AS d,
    row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
  FROM ({counted}))
WHERE d < least(total * 0.2::DOUBLE, 50){"" if limit is None else f" AND rank <= {limit}"}"""


def _warnings_sql(src: str, columns) -> str:
    return f"""
SELECT column_name, round(max(n) / min(n), 2) AS ratio,
  CASE WHEN max(n) / min(n) > 10 THEN 'SEVERE' ELSE 'WARNING' END AS severity
FROM ({_top_sql(src, columns, None)}) GROUP BY column_name
HAVING count(*) >= 2 AND max(n) / min(n) > 3"""


def _duplicates_sql(src: str) -> str:
    return f"""
SELECT t.n AS row_count, u.n AS distinct_rows, t.n - u.n AS duplicate_rows
FROM (SELECT count(*) AS n FROM {src}) t, (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM {src})) u"""


def _missing_sql(src: str, columns) -> str:
    return f"""
SELECT max(row_count) AS row_count, sum(null_count)::BIGINT AS missing_cells,
  sum(row_count)::BIGINT AS cells FROM ({_counts_sql(src, columns, False)})"""


def _quality_sql(src: str, columns) -> str:
    return f"""
SELECT m.row_count, m.missing_cells, d.duplicate_rows,
  CASE WHEN m.row_count > 0 THEN greatest(0.0, least(100.0, round(
    100.0 - m.missing_cells * 30.0 / m.cells - d.duplicate_rows * 20.0 / m.row_count, 2)))
  ELSE 0 END::DOUBLE AS quality_score
FROM ({_missing_sql(src, columns)}) m, ({_duplicates_sql(src)}) d"""


def _distribution_sql(src: str, column: str) -> str:
    return (
        f'SELECT {column} AS "class", count(*) AS n, '
        f"round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM {src} GROUP BY {column}"
    )


def _imbalance_sql(src: str, column: str) -> str:
    return f"""
SELECT sum(n)::BIGINT AS total, count(*) AS classes, round(max(n) / min(n), 2) AS ratio,
  max(n) / min(n) > 1.5 AS is_imbalanced,
  CASE WHEN max(n) / min(n) > 10 THEN 'SEVERE' WHEN max(n) / min(n) > 3 THEN 'WARNING'
       WHEN max(n) / min(n) > 1.5 THEN 'NOTICE' END AS severity
FROM (SELECT count(*) AS n FROM {src} GROUP BY {column})"""


def _fleet(spark, d):
    return P.fleet_profiles({t: read(spark, d, t) for t in TABLES})


def _fleet_sql() -> str:
    return union_sql(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(c)}::BIGINT AS column_count, "
        f"CASE WHEN count(*) > 0 THEN 'PROFILED' ELSE 'EMPTY' END AS status FROM {t}"
        for t, c in COLUMNS.items()
    )


def _fleet_by_source(spark, d):
    """One profile row per source, as if each were a data set of its own."""
    status = F.when(F.col("table_name").isin("src1", "src2"), "CLEANED").when(
        F.col("table_name") == "src3", "EMPTY"
    )
    return P.fleet_totals(
        read(spark, d, "documents")
        .groupBy(F.col("source").alias("table_name"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("n_chars").alias("bytes"))
        .withColumns({"column_count": F.lit(5).cast("bigint"), "status": status.otherwise("PROFILED")})
    )


_holes, _hole_names = LINEITEM_HOLES.sql(), COLUMNS["lineitem"]

QUERIES = {
    "profile_numeric_lineitem": lambda s, d: rounded(P.numeric_profile(read(s, d, "lineitem"))),
    "profile_numeric_holes": lambda s, d: rounded(P.numeric_summary(LINEITEM_HOLES.load(s, d))),
    "profile_whole_table": _whole_profile,
    "table_shape": lambda s, d: P.table_shape(read(s, d, "lineitem")),
    "profile_nulls": lambda s, d: P.null_counts(LINEITEM_HOLES.load(s, d)),
    "profile_column_counts": lambda s, d: P.column_counts(LINEITEM_HOLES.load(s, d)),
    "profile_distinct_embeddings": lambda s, d: P.column_counts(read(s, d, "embeddings")),
    "profile_distinct_documents": lambda s, d: P.column_counts(read(s, d, "documents")),
    "profile_categorical_flag": lambda s, d: P.categorical_flags(DOCUMENTS_ROUGH.load(s, d)),
    "profile_top_values": lambda s, d: P.top_values(DOCUMENTS_ROUGH.load(s, d)),
    "profile_top_values_part": lambda s, d: P.top_values(read(s, d, "part")),
    "duplicate_rows": lambda s, d: P.duplicate_rows(ORDERS_DUPS.load(s, d)),
    "duplicate_rows_documents": lambda s, d: P.duplicate_rows(DOCUMENTS_ROUGH.load(s, d)),
    "imbalance_warnings_conversations": lambda s, d: P.imbalance_warnings(
        read(s, d, "conversations")
    ),
    "imbalance_warnings_documents": lambda s, d: P.imbalance_warnings(DOCUMENTS_ROUGH.load(s, d)),
    "class_distribution_labels": lambda s, d: P.class_distribution(read(s, d, "labels"), "quality"),
    "class_distribution_with_null": lambda s, d: P.class_distribution(
        LINEITEM_HOLES.load(s, d), "l_returnflag"
    ),
    "class_imbalance_labels": lambda s, d: P.class_imbalance(read(s, d, "labels"), "toxic"),
    "class_imbalance_conversations": lambda s, d: P.class_imbalance(
        read(s, d, "conversations"), "role"
    ),
    "quality_score": lambda s, d: P.quality_score(LINEITEM_HOLES.load(s, d)),
    "quality_score_customer": lambda s, d: P.quality_score(CUSTOMER_ROUGH.load(s, d)),
    "missing_rate": lambda s, d: P.missing_rate(LINEITEM_HOLES.load(s, d)),
    "missing_rate_top3": lambda s, d: P.most_missing(LINEITEM_HOLES.load(s, d)),
    "fleet_profiles": _fleet,
    "fleet_totals": lambda s, d: P.fleet_totals(_fleet(s, d)),
    "fleet_totals_with_sizes": _fleet_by_source,
    "imbalance_warnings_many_values": lambda s, d: P.imbalance_warnings(ORDERS_RARE.load(s, d)),
    "categorical_flag_no_text": lambda s, d: P.categorical_flags(read(s, d, "labels")),
}

ORACLES = {
    "profile_numeric_lineitem": _joined_sql("lineitem", LINEITEM_NUMBERS, LINEITEM_NUMBERS),
    "profile_numeric_holes": _numeric_sql(_holes, LINEITEM_NUMBERS),
    "profile_whole_table": _whole_profile_sql(),
    "table_shape": "SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem",
    "profile_nulls": _counts_sql(_holes, _hole_names, False),
    "profile_column_counts": _counts_sql(_holes, _hole_names),
    "profile_distinct_embeddings": _counts_sql("embeddings", COLUMNS["embeddings"]),
    "profile_distinct_documents": _counts_sql("documents", COLUMNS["documents"]),
    "profile_categorical_flag": f"""
SELECT column_name, CASE column_name WHEN 'text' THEN 1 WHEN 'lang' THEN 2 ELSE 3 END AS ordinal,
  row_count, distinct_count, distinct_count < least(row_count * 0.2::DOUBLE, 50) AS is_categorical
FROM ({_counts_sql(DOCUMENTS_ROUGH.sql(), ["text", "lang", "source"])})""",
    "profile_top_values": _top_sql(DOCUMENTS_ROUGH.sql(), ["text", "lang", "source"]),
    "profile_top_values_part": _top_sql("part", ["p_name", "p_brand", "p_type"]),
    "duplicate_rows": _duplicates_sql(ORDERS_DUPS.sql()),
    "duplicate_rows_documents": _duplicates_sql(DOCUMENTS_ROUGH.sql()),
    "imbalance_warnings_conversations": _warnings_sql("conversations", ["role", "text"]),
    "imbalance_warnings_documents": _warnings_sql(
        DOCUMENTS_ROUGH.sql(), ["text", "lang", "source"]
    ),
    "class_distribution_labels": _distribution_sql("labels", "quality"),
    "class_distribution_with_null": _distribution_sql(_holes, "l_returnflag"),
    "class_imbalance_labels": _imbalance_sql("labels", "toxic"),
    "class_imbalance_conversations": _imbalance_sql("conversations", "role"),
    "quality_score": _quality_sql(_holes, _hole_names),
    "quality_score_customer": _quality_sql(CUSTOMER_ROUGH.sql(), COLUMNS["customer"]),
    "missing_rate": (
        f"SELECT *, round(missing_cells / cells, 6) AS missing_rate FROM ({_missing_sql(_holes, _hole_names)})"
    ),
    "missing_rate_top3": f"""
SELECT column_name, ordinal, null_count, null_pct FROM ({_counts_sql(_holes, _hole_names)})
ORDER BY null_pct DESC, ordinal LIMIT 3""",
    "fleet_profiles": _fleet_sql(),
    "fleet_totals": f"""
SELECT count(*) AS tables, sum(row_count)::BIGINT AS total_rows,
  sum(column_count)::BIGINT AS total_columns, NULL::BIGINT AS total_bytes,
  count(*) FILTER (status = 'PROFILED') AS profiled, 0::BIGINT AS cleaned,
  count(*) FILTER (status = 'EMPTY') AS empty FROM ({_fleet_sql()})""",
    "fleet_totals_with_sizes": """
SELECT count(DISTINCT source) AS tables, count(*) AS total_rows, count(DISTINCT source) * 5 AS total_columns,
  sum(n_chars)::BIGINT AS total_bytes, count(DISTINCT source) FILTER (source <> 'src3') AS profiled,
  count(DISTINCT source) FILTER (source IN ('src1', 'src2')) AS cleaned,
  count(DISTINCT source) FILTER (source = 'src3') AS empty FROM documents""",
    "imbalance_warnings_many_values": _warnings_sql(ORDERS_RARE.sql(), ["mark"]),
    "categorical_flag_no_text": f"""
SELECT column_name, ordinal, row_count, distinct_count, true AS is_categorical
FROM ({_counts_sql("labels", COLUMNS["labels"])}) WHERE false""",
}
