"""Whole jobs: cleaning plans, preparation for learning, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepkit import CleanPlan, clean_to_parquet, prepare, run_clean
from prepkit.functions.columns import union_all
from prepkit.sources import io
from prepkit.sources.scratch import scratch_path
from queryset.cleaning import code_sql, mode_sql, outside_sql
from queryset.common import (
    COLUMNS,
    CUSTOMER_ROUGH,
    ORDERS_DUPS,
    TABLES,
    read,
    rounded,
    union_sql,
)
from queryset.profiling import _duplicates_sql
from queryset.sampling import ranked_sql, resample_sql

# Sizes of every magnitude.
_size = (
    "CASE l_linenumber WHEN 1 THEN l_partkey % 1024 WHEN 2 THEN l_partkey * 4099 "
    "WHEN 3 THEN l_partkey * 4000037 ELSE l_partkey * 1000000007 END"
)
CUSTOMER_PLAN = CleanPlan(
    filter_columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    remove_duplicates=True,
    handle_missing="auto",
    convert_types={"c_nationkey": "float64"},
    remove_outliers=True,
    normalize=True,
    encode_categoricals=True,
    balance_target="c_mktsegment",
    keys=["c_name"],
)
EVENTS_PLAN = CleanPlan(
    filter_columns=["event_id", "user_id", "event_type", "value"],
    remove_outliers=True,
    outlier_mode="joint",
    balance_target="event_type",
    balance_method="oversample",
    keys=["event_id"],
)
DROP_PLAN = CleanPlan(
    remove_duplicates=True,
    missing_strategy_map={"c_mktsegment": "drop", "c_acctbal": "fill_median"},
    remove_outliers=True,
    outlier_method="zscore",
    outlier_action="cap",
    encode_categoricals=True,
)

_customer = COLUMNS["customer"]
_numbers = ["c_custkey", "c_nationkey", "c_acctbal"]
_src = CUSTOMER_ROUGH.sql()


def _customer_ctes() -> str:
    """Steps of the customer plan up to the encoded table ``e``."""
    scaled = ", ".join(
        f"({c}::DOUBLE - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}"
        if c in _numbers
        else c
        for c in _customer
    )
    return f"""
u AS (SELECT DISTINCT * FROM {_src}),
f AS (SELECT c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey,
  coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM u)) AS c_acctbal,
  coalesce(c_mktsegment, {mode_sql("u", "c_mktsegment")}) AS c_mktsegment FROM u),
o AS ({outside_sql("f", _numbers)}),
n AS (SELECT {scaled} FROM o),
e AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, {code_sql("c_mktsegment")} AS c_mktsegment FROM n)"""


def _customer_sql() -> str:
    items = ", ".join(f"round({c}, 6) AS {c}" if c in _numbers else c for c in _customer)
    balanced = resample_sql("e", _customer, "c_mktsegment", "smallest", "c_name")
    return f"WITH {_customer_ctes()},\nr AS ({balanced})\nSELECT {items} FROM r"


def _effects_sql() -> str:
    counts = {
        "i": f"SELECT count(*) FROM {_src}",
        "u": "SELECT count(*) FROM u",
        "o": "SELECT count(*) FROM o",
        "b": (
            "SELECT CAST(sum(n) AS BIGINT) FROM "
            "(SELECT min(count(*)) OVER () AS n FROM e GROUP BY c_mktsegment)"
        ),
    }
    steps = [
        ("filter_columns", "5", "i", "i"),
        ("remove_duplicates", "5", "i", "u"),
        ("handle_missing", "2", "u", "u"),
        ("convert_types", "1", "u", "u"),
        ("handle_outliers_iqr_remove", "3", "u", "o"),
        ("normalize", "3", "o", "o"),
        ("encode_categoricals", "1", "o", "o"),
        ("balance_classes", "1", "o", "b"),
    ]
    rows = union_sql(
        f"SELECT {i} AS step, '{op}' AS operation, {k}::BIGINT AS columns, ({counts[a]}) AS rows_before, "
        f"({counts[b]}) AS rows_after, ({counts[a]}) - ({counts[b]}) AS rows_removed"
        for i, (op, k, a, b) in enumerate(steps, start=1)
    )
    return f"WITH {_customer_ctes()}\n{rows}"


def _nulls_sql() -> str:
    rows = union_sql(
        f"SELECT '{c}' AS column_name, (SELECT count(*) - count({c}) FROM {_src}) AS nulls_before, "
        f"(SELECT count(*) - count({c}) FROM e) AS nulls_after"
        for c in _customer
    )
    return f"WITH {_customer_ctes()}\n{rows}"


def _drop_sql() -> str:
    capped = ", ".join(
        f"round(least(greatest({c}, z.lo_{c}), z.hi_{c})::DOUBLE, 6) AS {c}"
        if c in _numbers
        else f"{code_sql(c)} AS {c}"
        if c == "c_mktsegment"
        else c
        for c in _customer
    )
    bounds = ", ".join(
        f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}"
        for c in _numbers
    )
    return f"""
WITH u AS (SELECT DISTINCT * FROM {_src}),
k AS (SELECT * FROM u WHERE c_mktsegment IS NOT NULL),
f AS (SELECT c_custkey, c_name, c_nationkey,
  coalesce(c_acctbal, (SELECT median(c_acctbal) FROM k)) AS c_acctbal, c_mktsegment FROM k),
z AS (SELECT {bounds} FROM f)
SELECT {capped} FROM f, z"""


def _events_sql() -> str:
    names = list(EVENTS_PLAN.filter_columns)
    kept = outside_sql("events", ["event_id", "user_id", "value"], mode="joint")
    return f"""
WITH o AS ({kept}),
r AS ({resample_sql("o", names, "event_type", "largest", "event_id")})
SELECT * FROM r"""


def _prepare_sql(target: str) -> str:
    numbers, codes = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderpriority"]
    names = COLUMNS["orders"]
    items = []
    for c in names:
        if c in numbers:
            items.append(
                f"round(({c}::DOUBLE - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}"
            )
        else:
            items.append(f"{code_sql(c)} AS {c}" if c in codes and c != target else c)
    return f"""
SELECT {", ".join(items)}, CASE WHEN rn <= greatest(1, floor(n_class * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM ({ranked_sql("orders", names, None, "o_orderkey")})"""


def _clean_written(s, d):
    path = scratch_path(s, "cleaned")
    return rounded(clean_to_parquet(CUSTOMER_ROUGH.load(s, d), CUSTOMER_PLAN, path).data)


def _round_trip(table: str, fmt: str):
    def run(s, d):
        df = read(s, d, table)
        path = f"{scratch_path(s, fmt)}/{table}.{fmt}"
        io.write_table(df, path, fmt)
        return io.read_table(s, path, schema=df.schema)

    return run


def _convert(table: str, fmt: str, infer: bool):
    """Text files to Parquet, with the types of the table or with inferred ones."""

    def run(s, d):
        df, base = read(s, d, table), scratch_path(s, "convert")
        io.write_table(df, f"{base}/{table}.{fmt}", fmt)
        schema = None if infer else df.schema
        return io.convert_to_parquet(
            s, f"{base}/{table}.{fmt}", f"{base}/{table}.parquet", schema=schema
        )

    return run


def _fleet_bytes(s, d):
    sizes = [io.dataset_size(read(s, d, t)).withColumn("table_name", F.lit(t)) for t in TABLES]
    return union_all(sizes)


QUERIES = {
    "clean_customer": lambda s, d: rounded(
        run_clean(CUSTOMER_ROUGH.load(s, d), CUSTOMER_PLAN, count=False).data
    ),
    "clean_customer_written": _clean_written,
    "clean_customer_drop_and_cap": lambda s, d: rounded(
        run_clean(CUSTOMER_ROUGH.load(s, d), DROP_PLAN, count=False).data
    ),
    "clean_events_oversampled": lambda s, d: run_clean(
        read(s, d, "events"), EVENTS_PLAN, count=False
    ).data,
    "clean_effects": lambda s, d: run_clean(CUSTOMER_ROUGH.load(s, d), CUSTOMER_PLAN).effects(),
    "null_before_after": lambda s, d: run_clean(
        CUSTOMER_ROUGH.load(s, d), CUSTOMER_PLAN, count=False
    ).null_counts(),
    "prepare_ml": lambda s, d: rounded(
        prepare(read(s, d, "orders"), "o_orderstatus", keys=["o_orderkey"]).data
    ),
    "prepare_ml_sizes": lambda s, d: prepare(
        read(s, d, "lineitem"), "l_returnflag", test_size=0.3
    ).sizes(),
    "table_info": lambda s, d: io.table_info(ORDERS_DUPS.load(s, d)),
    "roundtrip_parquet": _round_trip("lineitem", "parquet"),
    "roundtrip_csv": _round_trip("orders", "csv"),
    "roundtrip_json": _round_trip("documents", "json"),
    "roundtrip_csv_documents": _round_trip("documents", "csv"),
    "convert_csv": _convert("part", "csv", infer=False),
    "convert_csv_documents": _convert("documents", "csv", infer=True),
    "convert_json": _convert("conversations", "json", infer=True),
    "preview": lambda s, d: io.preview(read(s, d, "orders"), 9999, ["o_orderkey"]),
    "preview_default": lambda s, d: io.preview(read(s, d, "documents"), order_by=["doc_id"]),
    "size_text": lambda s, d: read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", io.size_text(F.expr(_size)).alias("size")
    ),
    "dataset_size": lambda s, d: io.dataset_size(read(s, d, "lineitem")),
    "fleet_bytes": _fleet_bytes,
}

ORACLES = {
    "clean_customer": _customer_sql(),
    "clean_customer_written": _customer_sql(),
    "clean_customer_drop_and_cap": _drop_sql(),
    "clean_events_oversampled": _events_sql(),
    "clean_effects": _effects_sql(),
    "null_before_after": _nulls_sql(),
    "prepare_ml": _prepare_sql("o_orderstatus"),
    "prepare_ml_sizes": """
SELECT count(*) - greatest(1, floor(count(*) * 0.3::DOUBLE))::BIGINT AS train_rows,
  greatest(1, floor(count(*) * 0.3::DOUBLE))::BIGINT AS test_rows FROM lineitem""",
    "table_info": f"""
SELECT row_count, distinct_rows, 6::BIGINT AS column_count FROM ({_duplicates_sql(ORDERS_DUPS.sql())})""",
    "roundtrip_parquet": "SELECT * FROM lineitem",
    "roundtrip_csv": "SELECT * FROM orders",
    "roundtrip_json": "SELECT * FROM documents",
    "roundtrip_csv_documents": "SELECT * FROM documents",
    "convert_csv": "SELECT * FROM part",
    "convert_csv_documents": "SELECT * FROM documents",
    "convert_json": "SELECT * FROM conversations",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 9999",
    "preview_default": "SELECT * FROM documents ORDER BY doc_id LIMIT 20",
    "size_text": """
SELECT l_orderkey, l_linenumber, CASE WHEN size < 1024 THEN size || ' B'
  WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0::DOUBLE)
  WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576.0::DOUBLE)
  ELSE printf('%.2f GB', size / 1073741824.0::DOUBLE) END AS size
FROM (SELECT *, CASE l_linenumber WHEN 1 THEN l_partkey % 1024 WHEN 2 THEN l_partkey * 4099
  WHEN 3 THEN l_partkey * 4000037 ELSE l_partkey * 1000000007 END AS size FROM lineitem)""",
}
