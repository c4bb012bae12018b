"""Quality rules whose cutoffs come with a guarantee on false rejections. DataFrame functions only.

For each rule, stratum and candidate cutoff, the good documents of a labelled holdout that the
cutoff would reject are counted. A cutoff is admissible if the exact (Clopper-Pearson) upper bound
on its false rejection rate is within the rule's share of the risk, at a confidence corrected for
all tests made (Bonferroni). The strictest admissible cutoff of each rule and stratum is taken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
BROADCAST_STRATA = 10_000  # most rows of the cutoff table that are broadcast
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # the base rules (fixed values)


@dataclass(frozen=True)
class Rule:
    """Reject a document whose ``metric`` lies beyond a cutoff: above it, or below if not ``above``.

    ``cutoffs`` is a fixed grid, chosen before any label is seen, and may be in any order.
    """

    name: str
    metric: str
    cutoffs: tuple[float, ...]
    above: bool = True

    def rejects(self, value: Column, cutoff: Column) -> Column:
        return value > cutoff if self.above else value < cutoff


_SHARES = tuple(i / 40 for i in range(1, 40))
RULES = [
    Rule("symbols", "symbol_share", _SHARES),
    Rule("repeated_lines", "dup_line_share", _SHARES),
    Rule("repeated_words", "repeat_share", _SHARES),
    Rule("long_words", "mean_word", tuple(4 + i / 4 for i in range(65))),
    Rule("short_words", "mean_word", tuple(1 + i / 8 for i in range(33)), above=False),
    Rule("capitals", "capital_share", _SHARES),
]


def metrics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None
) -> DataFrame:
    """``(id_col, stratum, n_words, word_chars, n_lines, n_symbols, n_dup_lines, n_repeat_words, n_capitals)``.

    Counts over the whole text of every row: words are runs of anything but ASCII white space;
    ``n_dup_lines`` counts lines with a word that equal an earlier one; ``n_repeat_words`` the
    words in 3-word windows found twice or more. Null is a text without words. ``stratum`` is an
    expression over the columns of ``docs``, as a string.

    Windows are first compared by a 64-bit hash. Only where some hash occurs twice are the windows
    sorted by their words and then by place: equal ones become neighbours, and the union of
    their places is measured, so no text costs more than a sort of its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = (F.lit(None) if stratum is None else stratum).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), kind.alias("stratum"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(_SPACE_CHARS))
    split = rows.select(
        "id",
        "stratum",
        F.length(F.translate("t", _SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE_CHARS)) != "").alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)).alias("w"),
    )
    at = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3))
    hashes = F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashed = split.select(
        "*", F.size("w").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"), hashes.alias("h")
    )
    window = F.transform(
        at, lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("s"), i.alias("i"))
    )
    sorted_ = hashed.select(
        "id", "stratum", "word_chars", "n_symbols", "n_capitals", "n_words", "n_lines",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(window)).alias("s"),
    )
    place = F.filter(
        F.transform("s", lambda x, k: F.when(
            (F.get("s", k - 1)["s"] == x["s"]) | (F.get("s", k + 1)["s"] == x["s"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    repeated = sorted_.withColumn("p", F.sort_array(place)).withColumn(
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform("p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - i, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
            F.lit(0),
        ).cast("bigint"),
    )
    return repeated.select(
        F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"
    )


def _shares(measured: DataFrame) -> DataFrame:
    """With the rules' metrics; null where the divisor is zero, which no rule rejects."""
    def share(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    return measured.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "mean_word": share("word_chars", "n_words"),
            "capital_share": share("n_capitals", "word_chars"),
        }
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial with ``n`` trials of probability ``p``.

    Terms are summed from the k-th downwards. Below the mean they shrink by a growing factor, and
    those under e^-50 of the largest are nothing to a double: about sqrt(n) terms count there.
    """
    k, n = k.cast("double"), n.cast("double")
    odds = F.log(F.lit((1 - p) / p))
    start = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))

    def add(state: Column, i: Column) -> Column:
        # relative to the k-th term; the ratio of the term of k - i to the one before
        term = state["term"] + F.log(k - i + 1) - F.log(n - k + i) + odds
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    # a term at a distance of d below the mean is at most exp(-d^2 / 2 n p) of the largest
    over = F.greatest(k - n * p, F.lit(0.0))
    most = F.least(k, F.ceil(over + F.sqrt(F.lit(100 * p) * n)) + 1).cast("bigint")
    steps = F.when(most >= 1, F.sequence(F.lit(1).cast("bigint"), most)).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))
    return start + F.aggregate(steps, zero, add, lambda s: s["total"])


def _log_factorial(x: Column) -> Column:
    """log x!: exact sums below 16, Stirling's series above (its error there is below 1e-12)."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), F.least(x, F.lit(15)).cast("int") + 1)
    y = F.greatest(x, F.lit(1.0))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return F.when(x < 16, small).otherwise(y * F.log(y) - y + F.log(2 * math.pi * y) / 2 + series)


def thresholds(
    holdout: DataFrame, rules: Sequence[Rule] = tuple(RULES), risk: float = 0.05, confidence: float = 0.95
) -> DataFrame:
    """``(rule, stratum, cutoff, n, rejected)``: the strictest admissible cutoff of each rule and stratum.

    ``holdout`` has a row per good document, with its ``stratum`` and the metrics. With
    probability ``confidence`` over the draw of the holdout, all cutoffs at once reject at most
    ``risk`` of the good documents of their stratum together: each rule has an equal share of the
    risk, and each of the tests (rules x cutoffs x strata) an equal share of the error. Cutoffs
    without enough evidence are not admissible, and a rule without one has no row.

    The upper bound at k of n is within r exactly if P(Binomial(n, r) <= k) is at most the error,
    which is what is computed. Counts are aggregated to a row per rule, cutoff and stratum.
    """
    tests = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(i if r.above else -i).alias("order"),
            F.lit(float(c)).alias("cutoff"),
            F.coalesce(r.rejects(F.col(r.metric), F.lit(float(c))), F.lit(False)).alias("hit"),
        )
        for r in rules
        for i, c in enumerate(sorted(r.cutoffs))
    ]
    each = holdout.select("stratum", F.explode(F.array(*tests)).alias("t"))
    counted = materialize(
        each.groupBy("stratum", "t.rule", "t.order", "t.cutoff").agg(
            F.count("*").alias("n"), F.count_if("t.hit").alias("rejected")
        ),
        "tests",
    )
    share = risk / max(1, len(rules))
    made = F.greatest(F.lit(1), F.lit(1) * counted.count())
    error = F.log(F.lit(1 - confidence) / made)
    # beyond the mean the distribution function is over a half: no need to sum it
    hopeful = counted.where(F.col("rejected") <= F.col("n") * share)
    allowed = hopeful.where(log_binomial_cdf(F.col("rejected"), F.col("n"), share) <= error)
    best = F.min_by(F.struct("cutoff", "n", "rejected"), "order").alias("best")
    return allowed.groupBy("rule", "stratum").agg(best).select("rule", "stratum", "best.*")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    good: Column,
    stratum: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    rules: Sequence[Rule] = tuple(RULES),
    risk: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """``(<columns of metrics>, base_failed, failed, kept)`` for every row.

    ``good`` is a condition over the columns of ``labels``; labelled good documents that pass the base
    rules are the holdout, all of them. ``failed``
    lists the rules, in their order, whose cutoff of the document's ``stratum`` (a condition over
    the columns of ``docs``; null is a stratum) rejects it. ``kept`` is false if a base rule or
    a learned one fails. Without labels only the base rules act. Documents of no words fail.

    Texts are measured once; the counts are written to the shared folder, and both the holdout
    and the judgement read them. Repeated rows are judged each.
    """
    measured = materialize(metrics(docs, id_col, text_col, stratum), "metrics")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    shares = _shares(measured).withColumn("base_failed", base_failed)
    fine = labels.where(good).select(F.col(label_id_col).alias("id")).where("id IS NOT NULL").distinct()
    fine = materialize(fine, "labels")
    holdout = shares.where("NOT base_failed").join(fine, F.col(id_col) == F.col("id"), "left_semi")
    found = thresholds(holdout, rules, risk, confidence)
    # one row per stratum seen among the labels, a column per rule
    by_stratum = found.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_{r.name}") for r in rules]
    )
    by_stratum = materialize(by_stratum.withColumnRenamed("stratum", "_stratum"), "cutoffs")
    cutoffs = F.broadcast(by_stratum) if by_stratum.count() <= BROADCAST_STRATA else by_stratum
    judged = shares.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(
        F.array(*[F.when(r.rejects(F.col(r.metric), F.col(f"_{r.name}")), F.lit(r.name)) for r in rules])
    )
    judged = judged.withColumn("failed", failed)
    return judged.select(
        *measured.columns, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept")
    )
