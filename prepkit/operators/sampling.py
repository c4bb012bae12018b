"""Reproducible sampling, class balancing and train/test splits.

Rows are ordered by the md5 of a seed and their key columns. Taking the first k rows of a class
then means keeping the rows up to one threshold hash, which a few counts find. The data itself is
never sorted or shuffled, however large one class is, and the same rows come out for any
partitioning and after any retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions.columns import col, cols, fresh, hash_bucket, hash_fraction, order_hash, rounded
from prepkit.operators.aggregates import lookup_join, settle
from prepkit.sources.scratch import materialize


def _keys(df: DataFrame, keys: Sequence[str] | None) -> list[Column]:
    return cols(df.columns if keys is None else keys)


# ---------------------------------------------------------------------------------------------
# samples by fraction


def sample_fraction(
    df: DataFrame, fraction: float = 0.1, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Each row independently with the given probability, decided by its hash."""
    return df.where(hash_fraction(order_hash(seed, _keys(df, keys))) < F.lit(float(fraction)))


def sample_size(
    df: DataFrame, size: int, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """About ``size`` rows: a fraction sample with size / row count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.coalesce(F.try_divide(F.lit(float(size)), total.cast("double")), F.lit(0.0))
    return df.where(hash_fraction(order_hash(seed, _keys(df, keys))) < share)


def _class_totals(df: DataFrame, column: str | None) -> DataFrame:
    """``(class, n)``; one row with a constant class if there is no class column."""
    key = col(column) if column else F.lit(0)
    return df.groupBy(key.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _spans(totals: DataFrame, small: bool) -> dict[str, int]:
    """Of settled class counts: ``smallest`` and ``largest`` class without the null class,
    ``widest`` class with it, and the ``total`` of all rows."""
    n = F.col("n")
    known = F.when(F.col("class").isNotNull(), n)
    spans = {
        "smallest": F.min(known), "largest": F.max(known), "widest": F.max(n), "total": F.sum(n)
    }
    if not small:
        return totals.agg(*[e.alias(k) for k, e in spans.items()]).collect()[0].asDict()
    rows = totals.collect()  # local rows: no job
    some = [r["n"] for r in rows if r["class"] is not None] or [0]
    every = [r["n"] for r in rows] or [0]
    return dict(zip(spans, (min(some), max(some), max(every), sum(every))))


def _sample_by_class(df, column, share: Column, keys, seed) -> DataFrame:
    """Keep rows by a per-class probability, an expression over ``n``, ``smallest`` and ``total``."""
    totals, small = settle(_class_totals(df, column))
    spans = {k: F.lit(v) for k, v in _spans(totals, small).items()}
    p, k = fresh(df.columns, "share"), fresh(df.columns, "class")
    shares = (
        totals.where(F.col("class").isNotNull())
        .withColumns(spans)
        .select(F.col("class").alias(k), share.cast("double").alias(p))
    )
    fraction = hash_fraction(order_hash(seed, _keys(df, keys)))
    joined = lookup_join(df, shares, small, col(column), k)
    return joined.where(fraction < F.col(p)).select(*cols(df.columns))


def sample_stratified_size(
    df: DataFrame, column: str, size: int, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """About ``size`` rows with the class shares kept; rows without a class are left out.

    Each class is sampled with probability round(n * size / total) / n.
    """
    share = F.round(F.col("n") * F.lit(size) / F.col("total")) / F.col("n")
    return _sample_by_class(df, column, share, keys, seed)


def undersample_approx(
    df: DataFrame,
    column: str,
    target: int | None = None,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Classes above the target (default: the smallest class) sampled down to about the target."""
    goal = F.col("smallest") if target is None else F.lit(target)
    share = F.least(F.lit(1.0), goal / F.col("n"))
    return _sample_by_class(df, column, share, keys, seed)


# ---------------------------------------------------------------------------------------------
# exact numbers


def _attach(rows: DataFrame, lookup: DataFrame, small: bool, key: Column | None) -> DataFrame:
    """Add the columns of ``lookup(k, ...)`` to the rows of class ``key`` (null matches null).

    Without a class column the lookup has one row, whose values are added as literals.
    """
    added = [c for c in lookup.columns if c != "k"]
    if key is not None:
        joined = lookup_join(rows, lookup, small, key, "k", null_safe=True, how="left")
        return joined.select(*cols(rows.columns), *[F.col(c) for c in added])
    found = lookup.collect()
    types_ = {f.name: f.dataType for f in lookup.schema.fields}
    values = {c: F.lit(found[0][c] if found else None).cast(types_[c]) for c in added}
    return rows.withColumns(values)


@dataclass(frozen=True)
class _Plan:
    """``(k, base, extra)`` per class: whole copies of each row, and rows that get one more."""

    classes: DataFrame
    small: bool
    digits: int  # leading hex digits of the hash that name a bucket


def _cuts(df: DataFrame, column: str | None, plan: _Plan, h: Column) -> tuple[DataFrame, bool]:
    """The hash of the ``extra``-th row of each class: ``(k, cut, cut_rows, cut_keep)``.

    Two narrowing counts: rows per (class, leading hash digits) find the bucket that holds the
    threshold, then the hashes of that bucket alone are ranked. Counting starts before the
    shuffle; with about as many buckets as rows per bucket, neither window sees more than some
    multiple of the square root of a class. ``cut_rows`` rows carry the hash, ``cut_keep`` of
    them are wanted; the two differ only if keys repeat.
    """
    key = F.col("k") if column else None
    base = df.select((col(column) if column else F.lit(0)).alias("k"), h.alias("h"))
    placed = base.withColumn("bucket", hash_bucket(F.col("h"), plan.digits))
    buckets = placed.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    holds = (F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("rows") < F.col("extra"))
    found, few = settle(
        _attach_to_lookup(
            buckets.withColumn("upto", F.sum("rows").over(order)), plan.classes, plan.small, key
        )
        .where((F.col("extra") > 0) & holds)
        .select(
            "k",
            F.col("bucket").alias("cut_bucket"),
            (F.col("extra") - F.col("upto") + F.col("rows")).alias("need"),
        )
    )
    inside = (
        _attach_to_lookup(placed, found, few, key)
        .where(F.col("bucket") == F.col("cut_bucket"))
        .groupBy("k", "need", "h")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    order = Window.partitionBy("k").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    holds = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need"))
    return settle(
        inside.withColumn("upto", F.sum("rows").over(order))
        .where(holds)
        .select(
            "k",
            F.col("h").alias("cut"),
            F.col("rows").alias("cut_rows"),
            (F.col("need") - F.col("upto") + F.col("rows")).alias("cut_keep"),
        )
    )


def _attach_to_lookup(rows: DataFrame, lookup: DataFrame, small: bool, key: Column | None):
    """:func:`_attach` for frames that carry their class as ``k`` themselves."""
    if key is None:
        return _attach(rows, lookup, small, None)
    return _attach(rows.withColumnRenamed("k", "own"), lookup, small, F.col("own")).withColumnRenamed(
        "own", "k"
    )


@dataclass
class _Ranked:
    """Rows with the copies their class gives to each (``base``) and whether they come first.

    ``tied`` holds the rows whose group of equals is cut in two, one row per group: ``rows``
    copies, ``keep`` of which come first.
    """

    names: list[str]
    marked: DataFrame
    base: str
    first: str
    tied: list[DataFrame]

    def copies(self) -> Column:
        return F.col(self.base) + F.col(self.first).cast("bigint")


def _rank(
    df: DataFrame,
    column: str | None,
    plan: _Plan,
    keys: Sequence[str] | None,
    seed: int,
) -> _Ranked:
    """Mark the first ``extra`` rows of every class."""
    names = df.columns
    own = {c: fresh(names, "plan_" + c) for c in ("h", "base", "cut", "cut_rows", "cut_keep", "first")}
    h = order_hash(seed, _keys(df, keys))
    cuts, few = _cuts(df, column, plan, h)
    lookup = _attach_to_lookup(plan.classes, cuts, few, F.col("k") if column else None)
    lookup = lookup.select(
        "k", *[F.col(c).alias(own[c]) for c in ("base", "cut", "cut_rows", "cut_keep")]
    )
    key = col(column) if column else None
    rows = _attach(df.withColumn(own["h"], h), lookup, plan.small, key)
    at, below = F.col(own["h"]) == F.col(own["cut"]), F.col(own["h"]) < F.col(own["cut"])
    cut_through = F.col(own["cut_rows"]) > F.col(own["cut_keep"])
    first = F.coalesce(below | at, F.lit(False)).alias(own["first"])
    kept = [*cols(names), F.col(own["base"]), first]
    if not cuts.where("cut_rows > cut_keep").head(1):
        return _Ranked(names, rows.select(*kept), own["base"], own["first"], [])

    split = F.coalesce(at & cut_through, F.lit(False))
    marked = rows.where(~split).select(*kept)
    tied = rows.where(split)
    if keys is not None:  # repeated keys: order the tied rows by a hash of the whole row
        again = lookup.where(cut_through).select(
            "k", F.col(own["base"]).alias("base"), F.col(own["cut_keep"]).alias("extra")
        )
        inner = _rank(tied.select(*cols(names)), column, replace(plan, classes=again), None, seed)
        more = inner.marked.withColumnsRenamed({inner.base: own["base"], inner.first: own["first"]})
        return _Ranked(names, marked.unionByName(more), own["base"], own["first"], inner.tied)
    n = own["cut_rows"]
    equal = tied.groupBy(*cols(names), own["base"], own["cut_keep"], own["h"])
    together = [own["h"]] + ([col(column)] if column else [])
    ordered = [c.cast("string") if types.has_map(df.schema[x].dataType) else c for x, c in zip(names, cols(names))]
    order = Window.partitionBy(*together).orderBy(*ordered)
    before = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    keep = F.greatest(F.lit(0), F.least(F.col(n), F.col(own["cut_keep"]) - before))
    groups = (
        equal.agg(F.count(F.lit(1)).alias(n))
        .withColumn(own["first"], keep)
        .drop(own["cut_keep"])
        .withColumnsRenamed({n: "tie_rows", own["first"]: "tie_keep"})
    )
    return _Ranked(names, marked, own["base"], own["first"], [groups])


def _repeat(frame: DataFrame, names: Sequence[str], times: Column) -> DataFrame:
    """Each row ``times`` times."""
    copy = fresh(frame.columns, "copy")
    return (
        frame.where(times > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
        .select(*cols(names))
    )


def _class_plan(df: DataFrame, column: str | None, quota: Column) -> _Plan:
    """The plan from the wanted rows of a class, an expression over ``n`` (rows of the class),
    ``smallest`` and ``largest``."""
    totals, small = settle(_class_totals(df, column))
    spans = _spans(totals, small)
    digits = max(1, min(5, math.ceil(math.log(max(spans["widest"] or 1, 1), 16) / 2)))
    plan = (
        totals.withColumns({k: F.lit(v) for k, v in spans.items()})
        .withColumn("quota", quota.cast("bigint"))
        .select(
            F.col("class").alias("k"),
            F.expr("quota div n").alias("base"),
            (F.col("quota") % F.col("n")).alias("extra"),
        )
    )
    return _Plan(plan if small else materialize(plan, "plan"), small, digits)


def resample(
    df: DataFrame,
    column: str | None,
    quota: Column,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Exactly ``quota`` rows of every class: whole copies of the class, then its first rows.

    A quota below the class size draws without replacement, one above it repeats rows. One scan
    of the data with a broadcast class plan; nothing is shuffled but the counts behind the plan.
    """
    plan = _class_plan(df, column, quota)
    ranked = _rank(df, column, plan, keys, seed)
    repeats = bool(plan.classes.where("base > 1 or (base = 1 and extra > 0)").head(1))
    if repeats:
        out = _repeat(ranked.marked, ranked.names, ranked.copies())
    else:
        out = ranked.marked.where(ranked.copies() > 0).select(*cols(ranked.names))
    for groups in ranked.tied:
        times = F.col(ranked.base) * F.col("tie_rows") + F.col("tie_keep")
        out = out.unionByName(_repeat(groups, ranked.names, times))
    return out


def sample_exact(
    df: DataFrame, size: int, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Exactly ``size`` rows (all of them if there are fewer)."""
    return resample(df, None, F.least(F.col("n"), F.lit(size)), keys, seed)


def sample_stratified_fraction(
    df: DataFrame, column: str, fraction: float, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Exactly round(fraction * n) rows of every class; the null class is a class."""
    return resample(df, column, F.round(F.col("n") * F.lit(float(fraction))), keys, seed)


def undersample(
    df: DataFrame, column: str, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """As many rows of every class as the smallest has. Rows without a class are left out."""
    rows = df.where(col(column).isNotNull())
    return resample(rows, column, F.col("smallest"), keys, seed)


def oversample(
    df: DataFrame, column: str, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Every class repeated up to the size of the largest. Rows without a class are left out."""
    rows = df.where(col(column).isNotNull())
    return resample(rows, column, F.col("largest"), keys, seed)


def balance_to_target(
    df: DataFrame, column: str, target: int, keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """``target`` rows of every class: larger classes are cut, smaller ones repeated."""
    rows = df.where(col(column).isNotNull())
    return resample(rows, column, F.lit(target), keys, seed)


def balance_classes(
    df: DataFrame,
    column: str,
    method: str = "undersample",
    target: int | None = None,
    keys: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Balance by ``undersample``, ``oversample`` or, with a target, ``combine`` both."""
    if method == "undersample" and target is None:
        return undersample(df, column, keys, seed)
    if method == "oversample" and target is None:
        return oversample(df, column, keys, seed)
    if target is None or method not in ("undersample", "oversample", "combine"):
        raise ValueError(f"unknown balancing: {method}, target {target}")
    goal = {
        "undersample": F.least(F.col("n"), F.lit(target)),
        "oversample": F.greatest(F.col("n"), F.lit(target)),
        "combine": F.lit(target),
    }[method]
    return resample(df.where(col(column).isNotNull()), column, goal, keys, seed)


def balance_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """``(class, n_before, n_after)`` per class, null class included; absent classes count 0."""
    old = _class_totals(before, column).withColumnsRenamed({"n": "n_before"})
    new = _class_totals(after, column).withColumnsRenamed({"class": "kept", "n": "n_after"})
    return old.join(new, F.col("class").eqNullSafe(F.col("kept")), "left").select(
        "class", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after")
    )


def sample_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(original_rows, sampled_rows, sample_rate)``, the rate with 4 decimals."""
    sampled = after.agg(F.count(F.lit(1))).scalar()
    return (
        before.agg(F.count(F.lit(1)).alias("original_rows"))
        .withColumn("sampled_rows", sampled)
        .withColumn(
            "sample_rate",
            rounded(F.try_divide(F.col("sampled_rows"), F.col("original_rows")), 4),
        )
    )


# ---------------------------------------------------------------------------------------------
# train and test


def _exact_split(df, column, quota, keys, seed, label) -> DataFrame:
    plan = _class_plan(df, column, quota)
    ranked = _rank(df, column, plan, keys, seed)
    part = F.when(ranked.copies() > 0, "test").otherwise("train").alias(label)
    out = ranked.marked.select(*cols(ranked.names), part)
    for groups in ranked.tied:
        for name, times in (("test", F.col("tie_keep")), ("train", F.col("tie_rows") - F.col("tie_keep"))):
            rows = _repeat(groups, ranked.names, times)
            out = out.unionByName(rows.withColumn(label, F.lit(name)))
    return out


def assign_split(
    df: DataFrame,
    test_size: float = 0.2,
    stratify: str | None = None,
    keys: Sequence[str] | None = None,
    seed: int = 42,
    exact: bool = False,
    label: str = "split",
) -> DataFrame:
    """Add a column that says ``train`` or ``test``; every row is in exactly one part.

    By default a row goes to the test part if its hash fraction is below ``test_size``: one
    narrow pass. With ``exact`` the test part has max(1, floor(n * test_size)) rows; with
    ``stratify`` it has round(n * test_size) rows of every class, nulls being a class.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    size = F.lit(float(test_size))
    if stratify is not None:
        return _exact_split(df, stratify, F.round(F.col("n") * size), keys, seed, label)
    if exact:
        quota = F.greatest(F.lit(1), F.floor(F.col("n") * size))
        return _exact_split(df, None, quota, keys, seed, label)
    fraction = hash_fraction(order_hash(seed, _keys(df, keys)))
    return df.withColumn(label, F.when(fraction < size, "test").otherwise("train"))


def train_test_split(df: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    """The two parts of :func:`assign_split` as ``(train, test)``."""
    label = fresh(df.columns, "split")
    both = assign_split(df, *args, label=label, **kwargs)
    return (
        both.where(F.col(label) == "train").drop(label),
        both.where(F.col(label) == "test").drop(label),
    )
