"""Rule-based reports: domain tags, task suitability, readiness score, recommendations."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit import types
from prepkit.functions import keywords as K
from prepkit.functions.columns import chunks, col, finite, rounded, union_all
from prepkit.operators.aggregates import one_row
from prepkit.operators.outliers import detect_outliers
from prepkit.operators.profile import (
    duplicate_rows,
    imbalance_warnings,
    null_counts,
)

def _trie_pattern(words: Sequence[str]) -> str:
    """A pattern for the longest of the words at a place: one branch per next character, so that a
    character is compared with the few that can follow, not with every word. Many branches are
    put behind looks at a class of characters, which pass over most of them at once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    branches = [(re.escape(c), _trie_pattern(rest)) for c, rest in sorted(heads.items())]
    if len(branches) > 8:
        some = chunks(branches, math.isqrt(len(branches)) + 1)
        parts = [f"(?=[{''.join(c for c, _ in g)}])(?:{'|'.join(c + rest for c, rest in g)})" for g in some]
    else:
        parts = [c + rest for c, rest in branches]
    return f"(?:{'|'.join(parts)}){'?' if '' in words else ''}"


def longest_words(text: Column, words: Sequence[str]) -> Column:
    """The longest of the words at every place of a text, each once, in no particular order.

    A look-ahead at every place captures it; so words may overlap.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_trie_pattern(words)}))"), F.lit(1)))


def words_within(word: Column, words: Sequence[str]) -> Column:
    """A found word and all others inside of it."""
    inner = {w: [v for v in words if v in w] for w in words}
    several = [F.when(word == w, F.array(*map(F.lit, v))) for w, v in inner.items() if len(v) > 1]
    return F.coalesce(*several, F.array(word))


# The most points of each term of the readiness score.
WEIGHTS = {
    "missing": 25,
    "duplicates": 15,
    "consistency": 15,
    "imbalance": 20,
    "variance": 15,
    "outliers": 10,
}


def domain_tags(df: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    """Best-matching domain per group: ``(<groups>, domain, score)``.

    The score of a domain is the number of its keywords found in any text of the group (in any
    case, anywhere in a word). Ties go to the domain listed first; no hit gives ``General``.

    One pass over each text finds the longest keyword at every place, all keywords at once; what is
    shuffled is a row per group and keyword found.
    """
    by = [col(g) for g in groups]
    words = sorted({w for listed in K.DOMAIN_KEYWORDS.values() for w in listed})
    found = longest_words(F.lower(F.coalesce(col(text), F.lit(""))), words)
    # The empty word stays in, so that a group without any hit is not lost.
    longest = df.select(*by, F.concat(F.array(F.lit("")), found).alias("words")).select(*by, F.explode("words").alias("word"))
    hits = longest.distinct().select(*by, F.explode(words_within(F.col("word"), words)).alias("word")).distinct()
    scores = []
    for listed in K.DOMAIN_KEYWORDS.values():
        times: dict[int, list[str]] = {}
        for w in dict.fromkeys(listed):
            times.setdefault(listed.count(w), []).append(w)
        points = F.lit(0)
        for n, some in times.items():
            points = points + F.when(F.col("word").isin(some), F.lit(n)).otherwise(F.lit(0))
        scores.append(F.sum(points).cast("int"))
    ranked = [
        F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(domain).alias("domain"))
        for i, (domain, score) in enumerate(zip(K.DOMAIN_KEYWORDS, scores))
    ]
    return hits.groupBy(*by).agg(F.greatest(*ranked).alias("best")).select(
        *by,
        F.when(F.col("best.score") > 0, F.col("best.domain"))
        .otherwise(K.DEFAULT_DOMAIN)
        .alias("domain"),
        F.col("best.score").alias("score"),
    )


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name, role, null_count)``: one profiled row per column."""
    frames = []
    for name, df in tables.items():
        roles = F.create_map(*[F.lit(x) for c, r in types.roles(df).items() for x in (c, r)])
        frames.append(
            null_counts(df).select(
                F.lit(name).alias("table_name"),
                "column_name",
                roles[F.col("column_name")].alias("role"),
                "null_count",
            )
        )
    return union_all(frames)


def _any_word(name: Column, words: Sequence[str]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def suitability(columns: DataFrame) -> DataFrame:
    """The task tags of each table from ``(table_name, column_name, role)`` rows.

    ``(table_name, columns, numeric_columns, tasks, confidence)``: all tags in their order, and the
    confidence of each (High or Medium), both joined by ``; ``.
    """
    name = F.col("column_name")
    facts = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("role") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("role") == "text").alias("text_columns"),
        F.max(_any_word(name, K.TIME_KEYWORDS)).alias("has_time"),
        F.max(_any_word(name, K.NLP_KEYWORDS)).alias("has_nlp"),
    )
    numeric = F.col("numeric_columns")
    some = numeric > 0
    tells = [
        (F.col("has_time") & some, F.lit("High")),
        (F.col("has_nlp"), F.lit("High")),
        (some & (numeric / F.col("columns") >= 0.4), F.lit("High")),
        (some, F.when(F.col("text_columns") > 0, "High").otherwise("Medium")),
        (numeric >= 3, F.lit("Medium")),
    ]
    tags = F.array_compact(
        F.array(
            *[
                F.when(told, F.struct(F.lit(tag).alias("task"), sure.alias("confidence")))
                for tag, (told, sure) in zip(K.TASK_TAGS, tells)
            ]
        )
    )
    default = F.array(F.struct(F.lit(K.DEFAULT_TASK).alias("task"), F.lit("Medium").alias("confidence")))
    chosen = facts.withColumn("tags", F.when(F.size(tags) == 0, default).otherwise(tags))
    return chosen.select(
        "table_name",
        "columns",
        "numeric_columns",
        F.concat_ws("; ", F.col("tags.task")).alias("tasks"),
        F.concat_ws("; ", F.col("tags.confidence")).alias("confidence"),
    )


def _is_flat(mean: float | None, std: float | None) -> bool:
    """Whether a column varies by less than 1 % of its mean (not at all, if the mean is 0)."""
    if std is None:
        return False
    return abs(std / mean) < 0.01 if mean else std == 0


def readiness_facts(df: DataFrame) -> DataFrame:
    """The one-row aggregate behind the readiness score and the recommendations.

    Everything in it describes the frame it is given, so a cleaned frame is scored as it is.
    """
    numeric = types.numeric_columns(df)
    exprs: dict = {("rows", None): F.count(F.lit(1))}
    exprs |= {("nulls", c): F.count_if(col(c).isNull()) for c in df.columns}
    for c in numeric:
        x = finite(col(c).cast("double"))
        exprs |= {("mean", c): F.avg(x), ("std", c): F.stddev_samp(x), ("size", c): F.approx_count_distinct(x)}
    found = one_row(df, exprs)
    rows, nulls = found["rows", None], {c: found["nulls", c] for c in df.columns}
    bad = {
        "high_missing": [c for c in df.columns if nulls[c] > rows * 0.5],
        "low_variance": [c for c in numeric if _is_flat(found["mean", c], found["std", c])],
        "outlier": [  # one row per numeric column
            r["column_name"]
            for r in (detect_outliers(df, sizes={c: found["size", c] for c in numeric}).collect() if numeric else [])
            if r["outlier_count"] / max(rows, 1) > 0.05
        ],
        "missing": [c for c in df.columns if nulls[c]],
    }
    tier = {r["column_name"]: r["severity"] for r in imbalance_warnings(df).collect()}  # a row per column
    bad["severe"] = [c for c in df.columns if tier.get(c) == "SEVERE"]
    bad["mild"] = [c for c in df.columns if tier.get(c) == "WARNING"]
    return duplicate_rows(df).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(sum(nulls.values())).cast("bigint").alias("missing_cells"),
        "duplicate_rows",
        *[F.lit(len(names)).alias(f"{kind}_columns") for kind, names in bad.items()],
        *[F.lit(", ".join(names)).alias(f"{kind}_names") for kind, names in bad.items()],
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _rates() -> tuple[Column, Column, Column]:
    rows, columns = F.col("row_count"), F.greatest(F.col("column_count"), F.lit(1))
    return (
        _share(F.col("missing_cells"), rows * columns),
        _share(F.col("duplicate_rows"), rows),
        columns,
    )


def readiness_score(df: DataFrame) -> DataFrame:
    """The six terms (1 decimal) and their rounded sum within 0..100, as one row."""
    missing, duplicates, columns = _rates()
    w = {k: F.lit(float(v)) for k, v in WEIGHTS.items()}
    zero = F.lit(0.0)
    terms = {
        "missing": F.greatest(zero, w["missing"] * (1 - missing * 4)),
        "duplicates": F.greatest(zero, w["duplicates"] * (1 - duplicates * 5)),
        "consistency": w["consistency"] * F.greatest(zero, 1 - F.col("high_missing_columns") / columns),
        "imbalance": F.greatest(
            zero, w["imbalance"] - F.col("severe_columns") * 10 - F.col("mild_columns") * 3
        ),
        "variance": w["variance"] * F.greatest(zero, 1 - F.col("low_variance_columns") / columns),
        "outliers": F.greatest(zero, w["outliers"] - F.col("outlier_columns") * 2),
    }
    total = F.bround(sum(terms.values(), zero), 0)
    return readiness_facts(df).select(
        *[rounded(t, 1).alias(f"{k}_score") for k, t in terms.items()],
        F.greatest(F.lit(0), F.least(F.lit(100), total.cast("int"))).alias("readiness_score"),
    )


def recommendations(df: DataFrame) -> DataFrame:
    """``(rule, fired, columns)`` rows of every cleaning and readiness rule, in a fixed order by name.

    ``columns`` lists the columns that a fired rule is about, in their order; null for rules about
    rows or the whole table.
    """
    missing, duplicates, _ = _rates()
    severe, mild = F.col("severe_columns") > 0, F.col("mild_columns") > 0
    fired = {
        "plan_missing_values": missing >= 0.05,
        "remove_duplicates": F.col("duplicate_rows") > 0,
        "resample_severe_imbalance": severe,
        "watch_mild_imbalance": ~severe & mild,
        "impute_before_training": missing > 0.05,
        "prevent_duplicate_leakage": duplicates > 0.01,
        "drop_half_empty_columns": F.col("high_missing_columns") > 0,
        "drop_flat_columns": F.col("low_variance_columns") > 0,
        "treat_outliers": F.col("outlier_columns") > 0,
    }
    issues = ["impute_before_training", "prevent_duplicate_leakage", "drop_half_empty_columns"]
    clean = ~severe & ~fired["drop_flat_columns"]
    for rule in issues:
        clean = clean & ~fired[rule]
    fired["ready_for_modeling"] = clean
    about = {
        "plan_missing_values": "missing_names",
        "impute_before_training": "missing_names",
        "resample_severe_imbalance": "severe_names",
        "watch_mild_imbalance": "mild_names",
        "drop_half_empty_columns": "high_missing_names",
        "drop_flat_columns": "low_variance_names",
        "treat_outliers": "outlier_names",
    }
    rows = [
        F.struct(
            F.lit(k).alias("rule"),
            v.alias("fired"),
            F.when(v, F.col(about[k]) if k in about else F.lit(None).cast("string")).alias("columns"),
        )
        for k, v in fired.items()
    ]
    return readiness_facts(df).select(F.inline(F.array(*rows)))

