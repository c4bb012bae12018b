"""Preparation for machine learning: scale, encode, split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import cols, fresh
from prepkit.operators import encoding
from prepkit.operators.sampling import assign_split
from prepkit.sources.io import write_table
from prepkit.sources.scratch import materialize


@dataclass(frozen=True)
class Prepared:
    """Train and test rows as one frame with a part label; the target is the last data column."""

    data: DataFrame
    label: str
    scaled: list[str]
    encoded: list[str]

    def part(self, name: str) -> DataFrame:
        return self.data.where(F.col(self.label) == name).drop(self.label)

    def train(self) -> DataFrame:
        return self.part("train")

    def test(self) -> DataFrame:
        return self.part("test")

    def sizes(self) -> DataFrame:
        """``(train_rows, test_rows)`` in one pass."""
        of = F.col(self.label)
        return self.data.agg(
            F.count_if(of == "train").alias("train_rows"),
            F.count_if(of == "test").alias("test_rows"),
        )


def prepare(
    df: DataFrame,
    target: str | None = None,
    test_size: float = 0.2,
    normalize: bool = True,
    encode: bool = True,
    keys: Sequence[str] | None = None,
    seed: int = 42,
    fit_on: str = "all",
) -> Prepared:
    """Scale and encode every column but the target, then split off exactly
    max(1, floor(n * test_size)) test rows.

    The split is decided on the input rows, by their ``keys``. Ranges and dictionaries come from
    all rows; ``fit_on="train"`` takes them from the training rows only, so that nothing of the
    test part leaks (its unseen categories become null). Scaling and encoding are projections on
    the split scan: the data is read once for the result.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"unknown fit_on: {fit_on}")
    label = fresh(df.columns, "split")
    features = [c for c in df.columns if c != target]
    split = assign_split(df, test_size, keys=keys, seed=seed, exact=True, label=label)
    basis = split.where(F.col(label) == "train") if fit_on == "train" else df
    basis = basis.select(*cols(features))
    ranges = encoding.scaling_ranges(basis) if normalize else {}
    dictionaries = encoding.label_dictionaries(basis) if encode else {}
    data = encoding.encode(encoding.scale(split, ranges), dictionaries)
    order = features + ([target] if target in df.columns else [])
    return Prepared(data.select(*cols(order), label), label, list(ranges), list(dictionaries))


def prepare_to_parquet(prepared: Prepared, train_path: str, test_path: str) -> None:
    """Write both parts; the plan runs once, into the shared folder, and the parts are cut from that."""
    once = replace(prepared, data=materialize(prepared.data, "prepared"))
    write_table(once.train(), train_path)
    write_table(once.test(), test_path)
