"""The cleaning job: a declarative plan of steps, applied in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from prepkit.operators import cleaning, encoding, outliers, sampling
from prepkit.operators.aggregates import local_frame
from prepkit.operators.profile import null_comparison
from prepkit.sources.io import write_table
from prepkit.sources.scratch import materialize


@dataclass(frozen=True)
class CleanPlan:
    """What to clean. The steps run in the order of the fields, whatever order they are given in.

    ``handle_missing`` is one strategy for all columns or ``auto``; ``missing_strategy_map`` has
    priority. ``drop_null_outliers`` makes outlier removal drop nulls too, as the legacy cleaner
    does. ``keys`` order the rows for balancing (all columns by default).
    """

    filter_columns: Sequence[str] | None = None
    remove_duplicates: bool = False
    handle_missing: str | None = None
    missing_strategy_map: Mapping[str, str] | None = None
    convert_types: Mapping[str, str] | None = None
    remove_outliers: bool = False
    outlier_method: str = "iqr"
    outlier_action: str = "remove"
    outlier_mode: str = "sequential"
    outlier_interpolation: str = "linear"
    drop_null_outliers: bool = False
    normalize: bool = False
    encode_categoricals: bool = False
    balance_target: str | None = None
    balance_method: str = "undersample"
    balance_count: int | None = None
    keys: Sequence[str] | None = None
    seed: int = 42


@dataclass
class CleanResult:
    """The cleaned frame (lazy) and the records of what was done.

    ``outliers`` (found before they are handled) is None unless asked for.
    """

    data: DataFrame
    source: DataFrame
    steps: list[dict] = field(default_factory=list)
    conversions: DataFrame | None = None
    outliers: DataFrame | None = None

    def effects(self) -> DataFrame:
        """``(step, operation, columns, rows_before, rows_after, rows_removed)`` per step."""
        rows = [
            (i + 1, s["operation"], s["columns"], s["before"], s["after"], s["before"] - s["after"])
            for i, s in enumerate(self.steps)
        ]
        return local_frame(
            self.data.sparkSession,
            rows,
            "step int, operation string, columns bigint, rows_before bigint, rows_after bigint, "
            "rows_removed bigint",
        )

    def null_counts(self) -> DataFrame:
        """Nulls per column before and after."""
        return null_comparison(self.source, self.data)


def run_clean(df: DataFrame, plan: CleanPlan, detect: bool = False, count: bool = True) -> CleanResult:
    """Apply a plan; ``count`` records row counts per step, ``detect`` the outliers found.

    Each step is a narrow projection or filter with literal statistics, so the steps after
    deduplication are planned as one scan. Deduplication is the one shuffle; its result is written
    to the shared folder when later steps have to read it more than once. Row counts are taken
    only after steps that can change them.
    """
    out = CleanResult(df, df)
    rows = df.count() if count else 0

    def record(operation: str, columns: int, changes_rows: bool = False) -> None:
        nonlocal rows
        before = rows
        if changes_rows and count:
            rows = out.data.count()
        out.steps.append(
            {"operation": operation, "columns": columns, "before": before, "after": rows}
        )

    if plan.filter_columns:
        out.data = cleaning.select_columns(out.data, plan.filter_columns)
        record("filter_columns", len(out.data.columns))

    strategies: str | Mapping[str, str] | None = plan.missing_strategy_map or plan.handle_missing
    if plan.remove_duplicates:
        out.data = cleaning.remove_duplicates(out.data)
        again = bool(
            strategies
            or plan.convert_types
            or plan.remove_outliers
            or plan.normalize
            or plan.encode_categoricals
            or plan.balance_target
        )
        if again or count or detect:
            out.data = materialize(out.data, "distinct")
        record("remove_duplicates", len(out.data.columns), True)

    if strategies:
        out.data, handled = cleaning.fill_missing(out.data, strategies)
        drops = "drop" in cleaning.expand_strategies(out.data, strategies).values()
        record("handle_missing", len(handled), drops)

    if plan.convert_types:
        out.data, out.conversions = cleaning.cast_columns(out.data, plan.convert_types)
        record("convert_types", len(plan.convert_types))

    if detect:
        out.outliers = outliers.detect_outliers(out.data, plan.outlier_interpolation)

    if plan.remove_outliers:
        numeric = len([c for c in out.data.schema.fields if cleaning.types.is_numeric(c.dataType)])
        if plan.outlier_action == "cap":
            out.data = outliers.cap_outliers(
                out.data, plan.outlier_method, plan.outlier_interpolation
            )
        elif plan.outlier_action == "remove":
            out.data = outliers.remove_outliers(
                out.data,
                plan.outlier_method,
                plan.outlier_mode,
                plan.drop_null_outliers,
                plan.outlier_interpolation,
            )
        else:
            raise ValueError(f"unknown outlier action: {plan.outlier_action}")
        name = f"handle_outliers_{plan.outlier_method}_{plan.outlier_action}"
        record(name, numeric, plan.outlier_action == "remove")

    if plan.normalize:
        ranges = encoding.scaling_ranges(out.data)
        out.data = encoding.scale(out.data, ranges)
        record("normalize", len(ranges))

    if plan.encode_categoricals:
        dictionaries = encoding.label_dictionaries(out.data)
        out.data = encoding.encode(out.data, dictionaries)
        record("encode_categoricals", len(dictionaries))

    if plan.balance_target and plan.balance_target in out.data.columns:
        out.data = sampling.balance_classes(
            out.data,
            plan.balance_target,
            plan.balance_method,
            plan.balance_count,
            plan.keys,
            plan.seed,
        )
        record("balance_classes", 1, True)
    return out


def clean_to_parquet(df: DataFrame, plan: CleanPlan, path: str) -> CleanResult:
    """Run a plan, write the cleaned table and return a result that scans what was written."""
    result = run_clean(df, plan)
    write_table(result.data, path)
    return replace(result, data=df.sparkSession.read.parquet(path))
