"""Secrets in every version of every text, each distinct text scanned once per rule version.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost non-overlapping matches of ``pattern`` (Java syntax) that pass.

    ``min_group`` is the least length of group 1, where that decides after the match is found.
    ``needle`` is a text that every match contains, and ``screen`` a cheaper pattern that every
    text with a match matches; both only spare work. A change of meaning needs a new ``version``.
    """

    kind: str
    pattern: str
    version: int = 1
    min_group: int = 0
    needle: str | None = None
    screen: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def present(self, text: Column) -> Column:
        if self.needle:
            return F.contains(text, F.lit(self.needle)) & text.rlike(self.pattern)
        return text.rlike(self.screen or self.pattern)


BASE_KINDS = ["assign", "access", "hex"]
RULES = [
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        min_group=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", needle="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", screen=r"[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needle="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", screen=r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needle="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needle="eyJ"),
]


def blob_of(text: Column) -> Column:
    """The content address of a text: SHA-256 of its UTF-8 bytes, null counting as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


@dataclass(frozen=True)
class Ledger:
    """What has been scanned and found so far, both small tables in storage.

    ``scanned`` (blob, rules): rule versions that a blob was scanned for, a row per run.
    ``findings`` (blob, rule, kind, start, stop): spans in code points, ``stop`` exclusive.
    """

    scanned: DataFrame
    findings: DataFrame

    def save(self, path: str) -> None:
        self.scanned.write.parquet(f"{path}/scanned")
        self.findings.write.parquet(f"{path}/findings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ledger":
        return Ledger(spark.read.parquet(f"{path}/scanned"), spark.read.parquet(f"{path}/findings"))

    def plus(self, other: "Ledger") -> "Ledger":
        """Both ledgers; what two overlapping runs found twice counts once where findings are read."""
        return Ledger(self.scanned.unionByName(other.scanned), self.findings.unionByName(other.findings))


def _spans(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(blob, rule, kind, start, stop)`` from ``(blob, text, todo)``; blobs are distinct.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches
    themselves; running sums of their lengths are the positions.
    """
    found = [
        F.when(
            F.array_contains("todo", rule.key) & rule.present(F.col("text")),
            F.struct(
                F.lit(rule.key).alias("rule"),
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.min_group).alias("min_group"),
                F.lit(rule.pattern).alias("pattern"),
                F.split("text", rule.pattern, -1).alias("gaps"),
                F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hits"),
                (
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(1))
                    if rule.min_group
                    else F.array().cast("array<string>")
                ).alias("groups"),
            ),
        )
        for rule in rules
    ]
    each = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f"))
    parts = each.select(
        "blob", "f.rule", "f.kind", "f.min_group", F.posexplode(F.arrays_zip("f.gaps", "f.hits", "f.groups")).alias("at", "m")
    ).where("m.hits IS NOT NULL")
    before = Window.partitionBy("blob", "rule").orderBy("at")
    sized = parts.select(
        "blob",
        "rule",
        "kind",
        "at",
        F.length("m.hits").alias("size"),
        (F.length("m.gaps") + F.length("m.hits")).cast("bigint").alias("step"),
        ((F.col("min_group") == 0) | (F.length("m.groups") >= F.col("min_group"))).alias("passes"),
    )
    placed = sized.withColumn("stop", F.sum("step").over(before))
    return placed.where("passes").select(
        "blob", "rule", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"
    )


def scan(
    history: DataFrame, text_col: str = "text", rules: Sequence[Rule] = tuple(RULES), ledger: Ledger | None = None
) -> Ledger:
    """Scan what the ledger lacks and return the additions as a ledger (``old.plus(new)`` is the next).

    ``history`` has a row per version of every path. Copies collapse to one blob before the
    shuffle (map-side), and only blob and rule-version pairs not in ``ledger`` are scanned, over
    whole texts. A null text is the empty blob; an empty history adds nothing.
    """
    texts = history.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    blobs = history.select(blob_of(F.col(text_col)).alias("blob")).distinct()
    if ledger is None:
        todo, scanned = texts.withColumn("todo", wanted), blobs.withColumn("rules", wanted)
    else:
        done = ledger.scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        todo = texts.join(done, "blob", "left").select("blob", "text", missing.alias("todo")).where(F.size("todo") > 0)
        scanned = blobs.join(done, "blob", "left").select("blob", missing.alias("rules")).where(F.size("rules") > 0)
    # the list of what was scanned needs the addresses alone, not the texts again
    return Ledger(scanned, materialize(_spans(todo, rules), "findings"))


def findings_by_path(
    history: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES)
) -> DataFrame:
    """``(id_col, blob, spans)`` for every row: sorted structs (start, place, kind, stop) of its blob's findings.

    ``place`` is the rule's place in ``rules``; findings of other rules or versions are left out;
    rows without findings have an empty array. The paths of a blob held by very many are split
    by adaptive execution.
    """
    order = F.lit(-1)
    for i, rule in enumerate(rules):
        order = F.when(F.col("rule") == rule.key, i).otherwise(order)
    spans = (
        ledger.findings.withColumn("place", order)
        .where("place >= 0")
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "place", "kind", "stop"))).alias("spans"))
    )
    # written, so that the join is of two plain shuffles and a blob with very many paths is split
    spans = materialize(spans, "spans")
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint>>")
    rows = history.select(F.col(id_col).alias(id_col), blob_of(F.col(text_col)).alias("blob"))
    return rows.join(spans, "blob", "left").select(id_col, "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
