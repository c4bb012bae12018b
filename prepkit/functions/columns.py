"""Small column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest string that is grouped by value; longer ones are grouped by their SHA-256.
LONG_TEXT = 64


def col(name: str) -> Column:
    """A column by its exact name: dots, spaces, quotes and backticks are not special."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fresh(taken: Iterable[str], base: str) -> str:
    """A helper column name that no user column carries (Spark compares names without case)."""
    used = {t.lower() for t in taken}
    name = base
    while name.lower() in used:
        name = "_" + name
    return name


def rounded(value: Column, scale: int) -> Column:
    """Round a double in binary arithmetic, halves away from zero.

    ``round(x, scale)`` rounds the shortest decimal text of a double, which turns 16.685 (stored
    as 16.68499...) into 16.69; scaling first gives 16.68.
    """
    unit = F.lit(float(10**scale))
    return F.round(value * unit, 0) / unit


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, 2 decimals; null when ``whole`` is 0."""
    return rounded(F.try_divide(part * F.lit(100.0), whole.cast("double")), 2)


def compact_text(value: Column) -> Column:
    """Equal strings give equal keys, and a key is never longer than about 80 bytes.

    Grouping by this key instead of the string keeps whole documents out of the shuffle. The
    key of a long string is longer than ``LONG_TEXT``, so it never meets a short string.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
    return F.when(F.length(value) > LONG_TEXT, digest).otherwise(value)


def order_hash(seed: int, keys: Sequence[Column]) -> Column:
    """md5 over the seed and the key columns: the row order of every sampling operator.

    It depends on the row alone, so it is the same for any partitioning and after task retries.
    """
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_fraction(h: Column) -> Column:
    """The leading 32 bits of an order hash as a number in [0, 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_bucket(h: Column, digits: int) -> Column:
    """The leading hex digits of an order hash as an integer; buckets follow the hash order."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def finite(value: Column) -> Column:
    """A double, or null where it is NaN or infinite.

    Ranges, quantiles, means and deviations are taken over finite values; NaN and infinities stay
    in the data as the values they are.
    """
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clip(value: Column, lower: float, upper: float) -> Column:
    """Clamp to [lower, upper]; null stays null (``least`` and ``greatest`` skip nulls)."""
    bounded = F.least(F.greatest(value.cast("double"), F.lit(lower)), F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def name_matches(name: str, words: Iterable[str], how: str) -> bool:
    """Name test of the rule-based reports: ``exact``, ``suffix`` (after ``_``), ``edges`` or ``inside``."""
    low = name.lower()
    if how == "suffix":
        return any(low == w or low.endswith("_" + w) for w in words)
    if how == "edges":
        return any(low.startswith(w) or low.endswith(w) for w in words)
    if how == "inside":
        return any(w in low for w in words)
    return low in set(words)
