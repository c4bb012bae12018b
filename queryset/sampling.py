"""Sampling, balancing and split queries. All orders are md5 orders, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepkit.operators import sampling as S
from queryset.common import (
    COLUMNS,
    LINEITEM_HOLES,
    ORDERS_DUPS,
    Frame,
    fraction_sql,
    order_hash_sql,
    read,
)

KEY = ["o_orderkey"]
# Documents whose language is sometimes unknown, without copies: doc_id is a key.
DOCUMENTS_CLASSES = Frame(
    "documents",
    {"lang": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END"},
    only=["doc_id", "lang", "source", "n_chars"],
)
# Two thirds of the rows are copies of one row.
LABELS_COPIES = Frame(
    "labels", {"quality": "CASE WHEN doc_id % 3 = 0 THEN quality ELSE 1 END", "toxic": "CASE WHEN doc_id % 3 = 0 THEN toxic ELSE 0 END", "doc_id": "CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 1 END"},
)
_orders = "SELECT * FROM orders"


def ranked_sql(src: str, columns, column: str | None, *keys: str) -> str:
    part = f"PARTITION BY {column} " if column else ""
    return f"""
SELECT {", ".join(columns)}, row_number() OVER ({part}ORDER BY {order_hash_sql(*keys)}, {", ".join(keys)}) AS rn,
  count(*) OVER ({part.strip()}) AS n_class FROM {src}"""


def resample_sql(src: str, columns, column: str | None, quota: str, *keys: str) -> str:
    """``quota`` may use n_class, smallest and largest."""
    spans = f"""
SELECT min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM {src}
{f"GROUP BY {column}" if column else ""})"""
    return f"""
WITH spans AS ({spans}),
picked AS (SELECT r.*, CAST({quota} AS BIGINT) AS quota FROM ({ranked_sql(src, columns, column, *keys)}) r, spans),
repeated AS (SELECT {", ".join(columns)},
  unnest(range(CAST(quota // n_class + CASE WHEN rn <= quota % n_class THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM picked)
SELECT {", ".join(columns)} FROM repeated"""


def _stratified_sql(src: str, column: str, share: str, *keys: str) -> str:
    return f"""
WITH c AS (SELECT {column} AS k, count(*) AS n FROM {src} GROUP BY {column}),
t AS (SELECT (SELECT count(*) FROM {src}) AS total, (SELECT min(n) FROM c WHERE k IS NOT NULL) AS smallest)
SELECT s.* FROM {src} s JOIN c ON s.{column} = c.k, t WHERE {fraction_sql(*keys)} < {share}"""


def _split_sql(src: str, columns, column: str | None, quota: str, *keys: str) -> str:
    return f"""
SELECT {", ".join(columns)}, CASE WHEN rn <= {quota} THEN 'test' ELSE 'train' END AS split
FROM ({ranked_sql(src, columns, column, *keys)})"""


def _keyed(operator, table: str, *args, keys, **kwargs):
    return lambda s, d: operator(read(s, d, table), *args, keys=keys, **kwargs)


def _report(s, d):
    before = DOCUMENTS_CLASSES.load(s, d)
    return S.balance_report(before, S.undersample(before, "lang", ["doc_id"]), "lang")


def _stats(s, d):
    before = read(s, d, "orders")
    return S.sample_stats(before, S.sample_fraction(before, 0.25, KEY))


def _copies_class(operator):
    return lambda s, d: operator(LABELS_COPIES.load(s, d), "quality")


_o = COLUMNS["orders"]
_l = COLUMNS["labels"]
_dc, _dc_sql = DOCUMENTS_CLASSES.columns, DOCUMENTS_CLASSES.sql()
_known = f"(SELECT * FROM {_dc_sql} WHERE lang IS NOT NULL)"
_conv = COLUMNS["conversations"]
_copies = LABELS_COPIES.sql()

QUERIES = {
    "sample_fraction": _keyed(S.sample_fraction, "orders", 0.2, keys=KEY),
    "sample_fraction_default": _keyed(S.sample_fraction, "events", keys=["event_id"]),
    "sample_size": _keyed(S.sample_size, "orders", 4000, keys=KEY),
    "sample_exact": _keyed(S.sample_exact, "orders", 4321, keys=KEY),
    "sample_stratified_size": lambda s, d: S.sample_stratified_size(
        DOCUMENTS_CLASSES.load(s, d), "lang", 400, ["doc_id"]
    ),
    "sample_stratified_fraction": lambda s, d: S.sample_stratified_fraction(
        DOCUMENTS_CLASSES.load(s, d), "lang", 0.3, ["doc_id"]
    ),
    "undersample_approx": _keyed(S.undersample_approx, "labels", "quality", keys=["doc_id"]),
    "undersample_approx_target": _keyed(
        S.undersample_approx, "documents", "lang", 120, keys=["doc_id"]
    ),
    "undersample_exact": _keyed(S.undersample, "orders", "o_orderstatus", keys=KEY),
    "undersample_conversations": _keyed(
        S.undersample, "conversations", "role", keys=["conv_id", "turn"]
    ),
    "undersample_many_classes": _keyed(
        S.undersample, "lineitem", "l_partkey", keys=["l_orderkey", "l_linenumber"]
    ),
    "undersample_copies": _copies_class(S.undersample),
    "oversample_exact": _keyed(S.oversample, "labels", "quality", keys=["doc_id"]),
    "oversample_unknown_class": lambda s, d: S.oversample(
        DOCUMENTS_CLASSES.load(s, d), "lang", ["doc_id"]
    ),
    "oversample_copies": _copies_class(S.oversample),
    "balance_to_target": lambda s, d: S.balance_to_target(
        DOCUMENTS_CLASSES.load(s, d), "lang", 150, ["doc_id"]
    ),
    "balance_report": _report,
    "split_fraction": _keyed(S.assign_split, "orders", 0.2, keys=KEY),
    "split_exact": _keyed(S.assign_split, "orders", 0.2, keys=KEY, exact=True),
    "split_stratified": _keyed(
        S.assign_split, "orders", 0.2, keys=KEY, stratify="o_orderpriority"
    ),
    "split_stratified_unknown": lambda s, d: S.assign_split(
        LINEITEM_HOLES.load(s, d), 0.1, "l_returnflag", keys=["l_orderkey", "l_linenumber"]
    ),
    "split_exact_copies": lambda s, d: S.assign_split(
        ORDERS_DUPS.load(s, d), 0.35, exact=True, keys=KEY
    ),
    "sample_stats": _stats,
}

ORACLES = {
    "sample_fraction": f"{_orders} WHERE {fraction_sql('o_orderkey')} < 0.2",
    "sample_fraction_default": f"SELECT * FROM events WHERE {fraction_sql('event_id')} < 0.1",
    "sample_size": (
        f"{_orders} WHERE {fraction_sql('o_orderkey')} < 4000.0 / (SELECT count(*) FROM orders)"
    ),
    "sample_exact": resample_sql("orders", _o, None, "least(n_class, 4321)", "o_orderkey"),
    "sample_stratified_size": _stratified_sql(
        _dc_sql, "lang", "round(n * 400 / total) / n", "doc_id"
    ),
    "sample_stratified_fraction": resample_sql(
        _dc_sql, _dc, "lang", "round(n_class * 0.3::DOUBLE)", "doc_id"
    ),
    "undersample_approx": _stratified_sql(
        "labels", "quality", "least(1.0, smallest / n)", "doc_id"
    ),
    "undersample_approx_target": _stratified_sql(
        "documents", "lang", "least(1.0, 120 / n)", "doc_id"
    ),
    "undersample_exact": resample_sql("orders", _o, "o_orderstatus", "smallest", "o_orderkey"),
    "undersample_conversations": resample_sql(
        "conversations", _conv, "role", "smallest", "conv_id", "turn"
    ),
    "undersample_many_classes": resample_sql(
        "lineitem", COLUMNS["lineitem"], "l_partkey", "smallest", "l_orderkey", "l_linenumber"
    ),
    "undersample_copies": resample_sql(_copies, _l, "quality", "smallest", "doc_id", "quality", "toxic"),
    "oversample_exact": resample_sql("labels", _l, "quality", "largest", "doc_id"),
    "oversample_unknown_class": resample_sql(_known, _dc, "lang", "largest", "doc_id"),
    "oversample_copies": resample_sql(_copies, _l, "quality", "largest", "doc_id", "quality", "toxic"),
    "balance_to_target": resample_sql(_known, _dc, "lang", "150", "doc_id"),
    "balance_report": f"""
SELECT lang AS "class", count(*) AS n_before, CASE WHEN lang IS NULL THEN 0 ELSE
  (SELECT min(n) FROM (SELECT count(*) AS n FROM {_known} GROUP BY lang)) END AS n_after
FROM {_dc_sql} GROUP BY lang""",
    "split_fraction": (
        f"SELECT *, CASE WHEN {fraction_sql('o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders"
    ),
    "split_exact": _split_sql(
        "orders", _o, None, "greatest(1, floor(n_class * 0.2::DOUBLE))", "o_orderkey"
    ),
    "split_stratified": _split_sql(
        "orders", _o, "o_orderpriority", "round(n_class * 0.2::DOUBLE)", "o_orderkey"
    ),
    "split_stratified_unknown": _split_sql(
        LINEITEM_HOLES.sql(),
        LINEITEM_HOLES.columns,
        "l_returnflag",
        "round(n_class * 0.1::DOUBLE)",
        "l_orderkey",
        "l_linenumber",
    ),
    "split_exact_copies": _split_sql(
        ORDERS_DUPS.sql(), _o, None, "greatest(1, floor(n_class * 0.35::DOUBLE))", "o_orderkey"
    ),
    "sample_stats": f"""
SELECT count(*) AS original_rows, count(*) FILTER ({fraction_sql("o_orderkey")} < 0.25) AS sampled_rows,
  round(count(*) FILTER ({fraction_sql("o_orderkey")} < 0.25) / count(*), 4) AS sample_rate FROM orders""",
}
