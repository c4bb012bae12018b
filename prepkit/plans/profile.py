"""The whole profile of one table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.operators import profile as P


@dataclass
class Profile:
    """Report frames of one table; each is evaluated when it is used."""

    source: DataFrame
    approx: bool = False

    def columns(self) -> DataFrame:
        """One row per column: types, null and distinct counts, numeric statistics, category flag."""
        df = self.source
        numeric = types.numeric_columns(df)
        others = [c for c in df.columns if c not in numeric]
        parts = []
        if others:
            parts.append(P.column_counts(df, others, self.approx).drop("ordinal"))
        if numeric:
            found = P.numeric_profile(df, numeric, distinct=not self.approx)
            if self.approx:
                rough = P.distinct_counts(df, numeric, approx=True)
                found = found.drop("distinct_count").join(F.broadcast(rough), "column_name")
            parts.append(found)
        counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        text = F.col("role") == "text"
        flag = text & P.is_categorical(F.col("distinct_count"), F.col("row_count"))
        return (
            P.schema_rows(df)
            .join(F.broadcast(counts), "column_name")  # one row per column on both sides
            .withColumn("is_categorical", F.when(F.col("role") != "other", flag))
        )

    def top_values(self) -> DataFrame:
        return P.top_values(self.source)

    def warnings(self) -> DataFrame:
        return P.imbalance_warnings(self.source)

    def quality(self) -> DataFrame:
        return P.quality_score(self.source)

    def duplicates(self) -> DataFrame:
        return P.duplicate_rows(self.source)


def profile_table(df: DataFrame, approx: bool = False) -> Profile:
    """The profile of a table. ``approx`` counts distinct values by a sketch: no value shuffle."""
    return Profile(df, approx)
