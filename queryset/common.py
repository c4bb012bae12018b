"""Input frames of the queries, each with the same definition in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ),
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMNS = {name: names.split() for name, names in TABLES.items()}
TEXT = set(
    "r_name n_name c_name c_mktsegment s_name p_name p_brand p_type o_orderstatus o_orderpriority "
    "l_returnflag l_linestatus event_type props text lang source url html role".split()
)
OTHER = {"o_orderdate", "l_shipdate", "ts", "embedding"}
LINEITEM_NUMBERS = COLUMNS["lineitem"][:8]


def role_of(column: str) -> str:
    if column in OTHER:
        return "other"
    return "text" if column in TEXT else "numeric"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, scale: int = 6) -> DataFrame:
    """Doubles to a fixed scale, so that summation order does not show."""
    return df.select(
        *[
            F.round(f"`{f.name}`", scale).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


class Frame:
    """A table with expressions over some of its columns, in Spark and in SQL."""

    def __init__(
        self,
        table: str,
        changed: dict[str, str] | None = None,
        again: str | None = None,
        only: Sequence[str] | None = None,
    ):
        self.table, self.changed, self.again = table, changed or {}, again
        base = list(only or COLUMNS[table])
        self.columns = base + [c for c in self.changed if c not in base]

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, self.table)
        if self.again:
            df = df.unionByName(df.where(self.again))
        return df.select(*[F.expr(self.changed.get(c, c)).alias(c) for c in self.columns])

    def sql(self) -> str:
        items = ", ".join(f"{self.changed.get(c, c)} AS {c}" for c in self.columns)
        rows = self.table
        if self.again:
            rows = f"(SELECT * FROM {rows} UNION ALL SELECT * FROM {rows} WHERE {self.again})"
        return f"(SELECT {items} FROM {rows})"


LINEITEM_HOLES = Frame(
    "lineitem",
    {
        "l_quantity": "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END",
        "l_discount": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END",
        "l_returnflag": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END",
    },
)
ORDERS_DUPS = Frame("orders", again="o_orderkey % 10 = 0")
EVENTS_PAIR = Frame("events", {"a": "value", "b": "value * value"}, only=["event_id"])
EVENTS_LINE = Frame(
    "events", {"a": "value", "b": "2 * value + 1", "c": "-value", "k": "7"}, only=["event_id"]
)
CUSTOMER_ROUGH = Frame(
    "customer",
    {
        "c_acctbal": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END",
        "c_mktsegment": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END",
    },
    again="c_custkey % 10 = 0",
)
DOCUMENTS_ROUGH = Frame(
    "documents",
    {
        "lang": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END",
        "source": "CASE WHEN doc_id % 4 = 0 THEN source END",
        "flat": "7",
    },
    again="doc_id % 10 = 0",
)


# Twenty common values and ten rare ones, which are not among the twenty most frequent.
ORDERS_RARE = Frame(
    "orders",
    {
        "mark": "CASE WHEN o_orderkey % 400 < 10 THEN concat('rare', CAST(o_orderkey % 10 AS STRING)) "
        "ELSE concat('v', CAST(o_orderkey % 20 AS STRING)) END"
    },
    only=["o_orderkey"],
)
# More than twenty numeric columns.
EVENTS_WIDE = Frame(
    "events", {f"c{i}": f"value * {i} + user_id % {i + 2}" for i in range(1, 25)}, only=["event_id"]
)
# Sixty-one numeric columns, every third with nulls, one constant.
EVENTS_SIXTY = Frame(
    "events",
    {
        f"c{i}": f"CASE WHEN event_id % {i + 3} <> 0 THEN value * {i % 5} + user_id % {i + 2} END"
        if i % 3 == 0
        else f"value * {i % 7} + user_id % {i + 2}"
        for i in range(1, 61)
    }
    | {"flat": "event_id - event_id + 7"},
    only=["event_id"],
)
EVENTS_NOT_FINITE = Frame(
    "events",
    {
        "value": "CASE WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) "
        "WHEN event_id % 10 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE value END"
    },
    only=["event_id", "value"],
)
EVENTS_FINITE = "(SELECT event_id, value FROM events WHERE event_id % 10 > 1)"
# A column that hints at a target by its name, and text columns that have to be counted.
DOCUMENTS_HINTS = Frame("documents", {"class_of_size": "n_chars % 7"}, only=["doc_id", "lang", "source", "text"])


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def order_hash_sql(*keys: str, seed: int = 42) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def fraction_sql(*keys: str, seed: int = 42) -> str:
    h = order_hash_sql(*keys, seed=seed)
    return f"(CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def quantile_sql(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"


def listed(columns: Sequence[str], **exprs: str) -> str:
    return ", ".join(f"{exprs[c]} AS {c}" if c in exprs else c for c in columns)


def rounded_list(columns: Sequence[str], doubles: Sequence[str]) -> str:
    return listed(columns, **{c: f"round({c}, 6)" for c in doubles})
