"""Shared aggregates: fused statistics, value counts, distinct counts and exact quantiles.

What leaves the executors here is one row per column (or per class, behind a checked bound).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prepkit.functions.columns import LONG_TEXT, chunks, col, compact_text, finite, fresh, union_all
from prepkit.sources.scratch import materialize
from prepkit.types import has_map, is_text

# Aggregate expressions per job: wider ones outgrow generated code.
AGG_WIDTH = 200
# Largest number of distinct values of one column that a single window task ranks.
WINDOW_ROWS = 2_000_000
# Rows of the sample that places the brackets of a quantile (never the quantile itself). One task
# merges its sketches, so it is small; counting over all rows decides, and a step narrows again.
SAMPLE_ROWS = 200_000
# Rank accuracy of the sketch over that sample: 1 / 10,000 of its rows.
SKETCH = 10_000
# Columns of up to about this many distinct values have their quantiles from one plain aggregate.
FEW_VALUES = 100_000
# Lookup frames up to this many rows are broadcast.
SMALL_ROWS = 10_000
# Tasks that the rows of one key are spread over where a lookup frame is joined by shuffle.
SALTS = 16


def one_row(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Evaluate many aggregates, fused into as few scans as generated code allows.

    Every chunk reads only the columns it names, so chunking adds no column reads.
    """
    out: dict = {}
    for chunk in chunks(list(exprs.items()), AGG_WIDTH):
        row = df.agg(*[e.alias(f"m{i}") for i, (_, e) in enumerate(chunk)]).collect()[0]
        out.update({name: row[i] for i, (name, _) in enumerate(chunk)})
    return out


def per_column(
    df: DataFrame, columns: Sequence[str], metrics: Callable[[str], Mapping[str, Column]]
) -> DataFrame:
    """One row per column: ``(column_name, ordinal, <metrics>)`` from fused aggregates.

    ``metrics`` maps a column name to its aggregates; all columns share the metric names and
    types. One job per chunk of aggregates, each with a one-row result that is then unfolded.
    """
    if not columns:
        return per_column(df, df.columns[:1], metrics).where(F.lit(False))
    ordinals = {c: i for i, c in enumerate(df.columns)}
    width = max(1, AGG_WIDTH // len(metrics(columns[0])))
    frames = []
    for chunk in chunks(list(columns), width):
        aggs, rows = [], []
        for i, name in enumerate(chunk):
            found = metrics(name)
            aggs += [e.alias(f"m{i}_{k}") for k, e in found.items()]
            rows.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(ordinals[name]).alias("ordinal"),
                    *[F.col(f"m{i}_{k}").alias(k) for k in found],
                )
            )
        frames.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return union_all(frames)


def summary(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Row, value and finite value count, and of the finite values mean, sample deviation, minimum
    and maximum of numeric columns, in one pass."""
    exprs: dict = {"rows": F.count(F.lit(1))}
    for c in columns:
        x = finite(col(c).cast("double"))
        exprs[c, "count"] = F.count(col(c))
        exprs[c, "finite"] = F.count(x)
        exprs[c, "mean"] = F.avg(x)
        exprs[c, "std"] = F.stddev_samp(x)
        exprs[c, "min"] = F.min(x)
        exprs[c, "max"] = F.max(x)
    found = one_row(df, exprs)
    metrics = ("count", "finite", "mean", "std", "min", "max")
    return {c: {"rows": found["rows"], **{m: found[c, m] for m in metrics}} for c in columns}


# ---------------------------------------------------------------------------------------------
# value counts


def _groups_by_type(df: DataFrame, columns: Sequence[str]) -> list[tuple[T.DataType, list[str]]]:
    """Columns of one type, which can be stacked without a cast; strings of all kinds are one."""
    groups: dict[str, tuple[T.DataType, list[str]]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            kind = T.StringType() if is_text(f.dataType) else f.dataType
            groups.setdefault(kind.json(), (kind, []))[1].append(f.name)
    return list(groups.values())


def _comparable(value: Column, data_type: T.DataType) -> Column:
    """Maps are compared by their sorted entries; nested maps by their JSON text."""
    if isinstance(data_type, T.MapType):
        if has_map(data_type.keyType) or has_map(data_type.valueType):
            return F.to_json(value)
        return F.array_sort(F.map_entries(value))
    return F.to_json(value) if has_map(data_type) else value


def value_counts(
    df: DataFrame, columns: Sequence[str], compact: bool = False
) -> list[tuple[list[str], DataFrame]]:
    """Counts of the non-null values: per column type ``(column_name, value, n)``.

    Columns of one type are stacked under each other and counted by (column, value): counting
    starts before the shuffle, so a hot value is one row per task. Each frame reads only its own
    columns and keeps their type. With ``compact`` long strings are replaced by their SHA-256.
    """
    out = []
    for data_type, names in _groups_by_type(df, columns):
        slots = [f"v{i}" for i in range(len(names))]
        values = []
        for slot, name in zip(slots, names):
            v = _comparable(col(name), data_type)
            if is_text(data_type):
                v = v.cast("string")
                v = compact_text(v) if compact else v
            values.append(v.alias(slot))
        naming = F.create_map(*[F.lit(x) for pair in zip(slots, names) for x in pair])
        frame = (
            df.select(*values)
            .unpivot([], slots, "slot", "value")
            .where(F.col("value").isNotNull())
            .groupBy("slot", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(naming[F.col("slot")].alias("column_name"), "value", "n")
        )
        out.append((names, frame))
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values: ``(column_name, distinct_count)``, one row per column with any."""
    if approx:
        types = {f.name: f.dataType for f in df.schema.fields}
        return per_column(
            df,
            columns,
            lambda c: {"distinct_count": F.approx_count_distinct(_comparable(col(c), types[c]))},
        ).drop("ordinal")
    if not columns:
        return local_frame(df.sparkSession, [], "column_name string, distinct_count bigint")
    return union_all(
        [
            frame.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
            for _, frame in value_counts(df, columns, compact=True)
        ]
    )


def few_valued(
    df: DataFrame, columns: Sequence[str], limit: int = 50, has_null: dict[str, bool] | None = None
) -> list[str]:
    """Columns that can have at most ``limit`` distinct non-null values.

    A HyperLogLog count with 512 registers (5 % error) is at most 512 * ln(512 / 462) = 52.6 for
    50 values or fewer, so a column above 64 is over the limit for certain. Columns returned here
    may still exceed the limit a little; an exact count over them is cheap and has to follow. For
    more than 50 values the bound does not hold, and the columns are counted exactly. With the
    sketch, ``has_null`` (if given) is filled with whether each column has nulls.
    """
    if not columns:
        return []
    if limit > 50:
        counted = distinct_counts(df, columns).collect()  # one row per column
        many = {r["column_name"] for r in counted if r["distinct_count"] > limit}
        return [c for c in columns if c not in many]
    exprs: dict = {c: F.approx_count_distinct(col(c), 0.05) for c in columns}
    exprs |= {("null", c): F.count_if(col(c).isNull()) > 0 for c in columns if has_null is not None}
    found = one_row(df, exprs)
    if has_null is not None:
        has_null |= {c: found["null", c] for c in columns}
    return [c for c in columns if found[c] <= 64]


def frequent_texts(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent strings of a column ``(value, n)``, the smaller ones on ties.

    Long strings are counted by their SHA-256 and their first characters, which place them in
    order but for strings that begin alike. Only the strings that can be among the wanted ones
    are fetched, copies collapsing before the shuffle.
    """
    value = col(column).cast("string")
    rows = df.where(value.isNotNull()).select(
        compact_text(value).alias("key"), F.substring(value, 1, LONG_TEXT).alias("head"), value.alias("value")
    )
    counted = rows.groupBy("key", "head").agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), "head").limit(limit).collect()
    if not best:
        return local_frame(df.sparkSession, [], "value string, n bigint")
    n, head = F.lit(best[-1]["n"]), F.lit(best[-1]["head"])
    chosen = counted.where((F.col("n") > n) | ((F.col("n") == n) & (F.col("head") <= head)))
    if all(r["key"] == r["head"] for r in best):  # short strings: the key is the string
        return local_frame(df.sparkSession, [(r["key"], r["n"]) for r in best], "value string, n bigint")
    chosen, small = settle(chosen.select(F.col("key").alias("k"), "n"))
    found = lookup_join(rows.select("key", "value"), chosen, small, F.col("key"), "k")
    values = found.groupBy("key", "n").agg(F.first("value").alias("value"))
    return values.orderBy(F.desc("n"), "value").limit(limit).select("value", "n")


def modes(df: DataFrame, columns: Sequence[str], long: Sequence[str] = ()) -> dict[str, str | None]:
    """Most frequent non-null value of atomic columns as text; the smallest one on ties.

    ``long`` are the columns with strings too long to be shuffled as they are.
    """
    out: dict[str, str | None] = {c: None for c in columns}
    for c in long:
        found = frequent_texts(df, c, 1).collect()
        out[c] = found[0]["value"] if found else None
    columns = [c for c in columns if c not in long]
    if not columns:
        return out
    best = []
    for _, frame in value_counts(df, columns):
        ranked = F.struct((-F.col("n")).alias("rank"), F.col("value"))
        best.append(
            frame.groupBy("column_name")
            .agg(F.min(ranked).alias("best"))
            .select("column_name", F.col("best.value").cast("string").alias("value"))
        )
    for row in union_all(best).collect():  # one row per column
        out[row["column_name"]] = row["value"]
    return out


# ---------------------------------------------------------------------------------------------
# exact quantiles


def _interpolate(position: float, lower: float, upper: float, how: str) -> float:
    base = math.floor(position)
    if lower == upper:
        return lower
    if how == "nearest":
        return upper if position - base >= 0.5 else lower
    return lower + (upper - lower) * (position - base)


def _rank_values(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple, list[Row]]:
    """The values at the wanted ranks of each bracket, by ``(column, lo, hi)``.

    Equal brackets share a slot. Values are counted first, so that the window of a slot sees
    distinct values only. Collected are at most two rows per quantile and the last of each slot,
    whose ``place`` is the number of distinct values.
    """
    slots: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        slots.setdefault(b.range(), []).append(b)
    found: dict[tuple, list[Row]] = {key: [] for key in slots}
    whole = [key for key in slots if key[1] is None]
    for chunk in [*chunks(whole, AGG_WIDTH), *chunks([key for key in slots if key not in whole], AGG_WIDTH)]:
        names = [f"s{i}" for i in range(len(chunk))]
        cells = [slots[key][0].cell().alias(name) for key, name in zip(chunk, names)]
        ranks = []
        for key, name in zip(chunk, names):
            wanted = sorted(
                {r - b.below for b in slots[key] for r in (*b.ranks, b.below + b.inside - 1)}
            )
            ranks += [F.lit(name), F.array(*[F.lit(r).cast("bigint") for r in wanted])]
        order = Window.partitionBy("slot").orderBy("value")
        upto, n = F.col("upto"), F.col("n")
        # few rows lie in a narrow bracket: the others go before every row is repeated for each slot
        held = df if chunk[0] in whole else df.where(reduce(Column.__or__, [slots[key][0].holds() for key in chunk]))
        rows = (
            held.select(*cells)
            .unpivot([], names, "slot", "value")
            .where(F.col("value").isNotNull())
            .groupBy("slot", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("place", F.row_number().over(order))
            .where(F.exists(F.create_map(*ranks)[F.col("slot")], lambda r: (r >= upto - n) & (r < upto)))
            .select("slot", "value", "n", "upto", "place")
        )
        for row in rows.collect():
            found[chunk[names.index(row["slot"])]].append(row)
    return found


def _at(rows: list[Row], rank: int) -> float:
    return next(r["value"] for r in rows if r["upto"] - r["n"] <= rank < r["upto"])


class _Bracket:
    """A value range of one column that is known to hold the order statistics of one quantile."""

    def __init__(self, name: str, column: str, position: float, count: int):
        self.name, self.column = name, column
        self.ranks = (math.floor(position), math.ceil(position))
        self.lo: float | None = None
        self.hi: float | None = None
        self.below, self.inside, self.distinct = 0, count, count
        self.width, self.halve = 5.0, False

    def range(self) -> tuple:
        return self.column, self.lo, self.hi

    def value(self) -> Column:
        return finite(col(self.column).cast("double"))

    def holds(self) -> Column:
        x = self.value()
        keep = x.isNotNull()
        if self.lo is not None:
            keep = keep & x.between(F.lit(self.lo), F.lit(self.hi))
        return keep

    def cell(self) -> Column:
        return F.when(self.holds(), self.value())

    def guess_edges(self, rate: float) -> Column:
        middle = (sum(self.ranks) / 2 - self.below + 0.5) / self.inside
        seen = max(1.0, self.inside * rate)
        slack = self.width * (math.sqrt(middle * (1 - middle) / seen) + 1 / SKETCH + 1 / seen)
        edges = F.array(F.lit(max(0.0, middle - slack)), F.lit(min(1.0, middle + slack)))
        return F.percentile_approx(self.cell(), edges, SKETCH)


def _narrow(df: DataFrame, wide: list[_Bracket], seed: int, sample_rows: int, window_rows: int) -> None:
    """One narrowing step: guess tighter brackets from a sample, then verify them by counting.

    A guess that does not hold its ranks is dropped and the next one is wider. Rows are counted in
    generated code; only brackets that hold more than ``window_rows`` of them have their values
    counted, by a sketch, which generated code has no place for.
    """
    rate = min(1.0, sample_rows / max(b.inside for b in wide))
    sample = df.sample(rate, seed) if rate < 1.0 else df
    guesses = one_row(sample, {b.name: b.guess_edges(rate) for b in wide})
    exprs = {}
    for b in wide:
        if guesses[b.name] is not None:
            lo, hi = guesses[b.name]
            x = b.value()
            exprs[b.name, "below"] = F.count_if(x < F.lit(lo))
            exprs[b.name, "inside"] = F.count_if(b.holds() & x.between(F.lit(lo), F.lit(hi)))
    found = one_row(df, exprs) if exprs else {}
    moved = []
    for b in wide:
        if guesses[b.name] is None:
            b.width *= 2
            continue
        lo, hi = guesses[b.name]
        below, inside = found[b.name, "below"], found[b.name, "inside"]
        if not (below <= b.ranks[0] and b.ranks[1] < below + inside):
            b.width *= 2
        elif (lo, hi) == (b.lo, b.hi):
            b.halve = True
        else:
            b.lo, b.hi, b.below, b.inside = lo, hi, below, inside
            b.distinct = 1 if lo == hi else inside
            moved.append(b)
    many = [b for b in moved if b.distinct > window_rows]
    found = one_row(df, {b.name: F.approx_count_distinct(b.cell()) for b in many})
    for b in many:
        b.distinct = found[b.name]


def _middle(lo: float, hi: float) -> float:
    """A cut with ``lo`` <= cut < ``hi``: between magnitudes where they differ, else halfway."""
    if lo < 0 < hi:
        return 0.0
    if hi <= 0:
        cut = -_middle(-hi, -lo)
        return cut if cut < hi else lo / 2 + hi / 2
    least = max(lo, 1e-308)
    return math.sqrt(least) * math.sqrt(hi) if hi > 4 * least else lo / 2 + hi / 2


def _halve(df: DataFrame, wide: list[_Bracket]) -> None:
    """One sure step: cut brackets inside their value range and keep the part that holds
    the ranks, or the two values beside the cut if the ranks lie on both sides of it.

    Needs no sample and always leaves out values, so it ends whatever the distribution is.
    """
    exprs: dict = {}
    for b in wide:
        if b.lo is None:
            exprs[b.name, "lo"], exprs[b.name, "hi"] = F.min(b.value()), F.max(b.value())
    found = one_row(df, exprs)
    for b in wide:
        if b.lo is None:
            b.lo, b.hi = found[b.name, "lo"], found[b.name, "hi"]
    exprs = {}
    for b in wide:
        middle = F.lit(_middle(b.lo, b.hi))
        low, high = b.holds() & (b.value() <= middle), b.holds() & (b.value() > middle)
        exprs[b.name, "left"] = F.count_if(low)
        exprs[b.name, "lo"], exprs[b.name, "hi"] = F.max(F.when(low, b.value())), F.min(F.when(high, b.value()))
    found = one_row(df, exprs)
    exprs = {}
    for b in wide:
        left = found[b.name, "left"]
        if b.ranks[0] >= b.below + left:
            b.lo = found[b.name, "hi"]
        elif b.ranks[1] < b.below + left:
            b.hi = found[b.name, "lo"]
        else:
            b.lo, b.hi = found[b.name, "lo"], found[b.name, "hi"]
        exprs[b.name, "below"] = F.count_if(b.value() < F.lit(b.lo))
        exprs[b.name, "inside"] = F.count_if(b.holds())
        exprs[b.name, "distinct"] = F.approx_count_distinct(b.cell())
    found = one_row(df, exprs)
    for b in wide:
        b.below, b.inside = found[b.name, "below"], found[b.name, "inside"]
        b.distinct = found[b.name, "distinct"]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    interpolation: str = "linear",
    counts: Mapping[str, int] | None = None,
    window_rows: int = WINDOW_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    sizes: Mapping[str, int] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of numeric columns over their finite values, as plain numbers.

    ``linear`` interpolates between the two neighbouring order statistics, ``nearest`` takes the
    closer one. ``counts`` are the finite values of the columns, if they are known.

    ``sizes`` are upper estimates of the distinct values (found here if not given). The built-in
    ``percentile`` keeps every distinct value of a column in one buffer, which suits columns of up to
    ``FEW_VALUES``: all of them share one aggregate. A column with more than ``window_rows`` values is first narrowed to brackets around the wanted
    ranks. A sample places the brackets, but counting over all rows decides whether a bracket
    holds its ranks, so the result is exact whatever the sample looks like. Only the values inside
    the final brackets are shuffled, and no task ranks more than about ``window_rows`` of them.
    """
    if interpolation != "linear" or window_rows < WINDOW_ROWS:
        return rank_columns(df, columns, probs, interpolation, counts, window_rows, sample_rows)[0]
    probs = list(dict.fromkeys(probs))
    if sizes is None:
        exprs: dict = {}
        for c in columns:
            x = finite(col(c).cast("double"))
            exprs[c, "count"], exprs[c, "distinct"] = F.count(x), F.approx_count_distinct(x)
        found = one_row(df, exprs)
        counts = {c: found[c, "count"] for c in columns}
        sizes = {c: found[c, "distinct"] for c in columns}
    few = [c for c in columns if sizes[c] <= FEW_VALUES]
    values = F.array(*[F.lit(float(p)) for p in probs])
    found = one_row(df, {c: F.percentile(finite(col(c).cast("double")), values) for c in few})
    out = {c: dict(zip(probs, found[c] or [None] * len(probs))) for c in few}
    rest = [c for c in columns if c not in out]
    if rest:
        known = None if counts is None else {c: counts[c] for c in rest}
        out |= rank_columns(df, rest, probs, interpolation, known, window_rows, sample_rows, sizes=sizes)[0]
    return {c: out[c] for c in columns}


def rank_columns(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    interpolation: str = "linear",
    counts: Mapping[str, int] | None = None,
    window_rows: int = WINDOW_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    max_samples: int = 20,
    sizes: Mapping[str, int] | None = None,
) -> tuple[dict[str, dict[float, float | None]], dict[str, int]]:
    """:func:`exact_quantiles`, and the distinct values of the columns that were ranked whole.

    Distinct values are those of the column as double. Columns of many rows but few values are
    ranked whole, which a sketch per column tells beforehand unless ``sizes`` are given. After ``max_samples`` sampled steps, or
    when a sample no longer helps, brackets are halved by value until they are narrow enough.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation: {interpolation}")
    probs = list(dict.fromkeys(probs))
    if counts is None:
        counts = one_row(df, {c: F.count(finite(col(c).cast("double"))) for c in columns})
    brackets = {
        (c, p): _Bracket(f"b{i}_{j}", c, p * (counts[c] - 1), counts[c])
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
        if counts[c]
    }
    if sizes is None:
        long = [c for c in columns if counts[c] > window_rows]
        sizes = one_row(df, {c: F.approx_count_distinct(finite(col(c).cast("double"))) for c in long})
    for b in brackets.values():
        b.distinct = min(b.distinct, sizes.get(b.column, b.distinct))
    step = 0
    while wide := [b for b in brackets.values() if b.distinct > window_rows]:
        sampled = [b for b in wide if not b.halve and step < max_samples]
        if sampled:
            _narrow(df, sampled, 17 + step, sample_rows, window_rows)
        if halved := [b for b in wide if b not in sampled]:
            _halve(df, halved)
        step += 1
    found = _rank_values(df, list(brackets.values()))
    out: dict[str, dict[float, float | None]] = {c: {p: None for p in probs} for c in columns}
    for (c, p), b in brackets.items():
        lower, upper = (_at(found[b.range()], r - b.below) for r in b.ranks)
        out[c][p] = _interpolate(p * (counts[c] - 1), lower, upper, interpolation)
    distinct = {
        c: max(r["place"] for r in rows) for (c, lo, _), rows in found.items() if lo is None
    }
    return out, distinct


# ---------------------------------------------------------------------------------------------
# lookup frames


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows as a local relation, whose size Catalyst knows and which needs no job to read."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrays = [
        pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType))
        for i, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def settle(frame: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a grouped frame and say whether it is small enough to broadcast.

    Up to ``limit`` rows it becomes a local frame, from one job and without a file. Beyond that it is
    written to the shared folder, and the written table is joined by shuffle.
    """
    rows = frame.limit(limit + 1).collect()
    if len(rows) <= limit:
        return local_frame(frame.sparkSession, rows, frame.schema), True
    return materialize(frame, "lookup"), False


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    small: bool,
    key: Column,
    lookup_key: str,
    null_safe: bool = False,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a settled lookup frame of distinct keys; drops nothing of either side's columns.

    Broadcast behind the size check. Beyond it the join shuffles, however small the lookup's file looks
    to Spark, and the lookup is repeated for ``salts`` salts, so that the rows of one key go to as many tasks.
    """
    def equal(right: Column) -> Column:
        return key.eqNullSafe(right) if null_safe else key == right

    if small:
        return df.join(F.broadcast(lookup), equal(F.col(lookup_key)), how)
    mine, theirs = (fresh([*df.columns, *lookup.columns], n) for n in ("salt", "lookup_salt"))
    plain = [col(f.name) for f in df.schema.fields if not has_map(f.dataType)] or [F.lit(0)]
    rows = df.withColumn(mine, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = equal(F.col(lookup_key)) & (F.col(mine) == F.col(theirs))
    return rows.join(repeated.hint("merge"), same, how).drop(mine, theirs)
