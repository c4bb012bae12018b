"""URL rules by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize

ALLOW, BLOCK = "allow", "block"
BROADCAST_ROWS = 200_000  # longest rule table that is broadcast; beyond it the join shuffles
PREFIX_CHARS = 8  # hex digits of the short hash: four bytes
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of host names that are blocked where no rule fits (the operator's own default list).
BLOCKED_HOST_WORDS = ["adult", "casino", "malware", "phishing", "porn", "scam", "spam", "xxx"]


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digested(df: DataFrame, kind: str, *parts: str) -> DataFrame:
    """With the full digest of an expression and its short prefix."""
    digest = F.coalesce(F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256), F.lit(""))
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX_CHARS))


def _looked_up(expressions: DataFrame, table: DataFrame) -> DataFrame:
    """Each ``digest`` with the ``held`` of the same digest in the table, both by their short prefixes.

    What shares a prefix is one row of the table, so an expression meets one row at most, and only
    then whole digests are compared. The table is broadcast if its row count allows.
    """
    table = materialize(table.groupBy("short").agg(F.collect_list(F.struct("digest", "held")).alias("entries")), "prefixes")
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    met = expressions.join(table, "short")
    same = F.filter("entries", lambda e: e["digest"] == F.col("digest"))
    return met.withColumn("held", F.explode(F.transform(same, lambda e: e["held"]))).drop("short", "digest", "entries")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_words: list[str] = BLOCKED_HOST_WORDS,
    default: str = ALLOW,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's; of the fitting rules the longest (host and path
    together, in characters) wins, at a tie the longer host, then block; ``rule`` is its host and path.
    Where none fits, ``rule`` is null and the verdict is block if a word of the host name
    (parted by dots, hyphens and underscores) is one of ``host_words``, else ``default``.

    Each different (host, path) is expanded to the host suffixes that have as many labels as some rule's;
    those that are hosts of rules, to the path prefixes that are as long as one of that host's. So an
    endless host or path yields few expressions. They meet the rules on the first bytes of a
    SHA-256, and the whole digest confirms. A null url or one without
    ``://`` has an empty host and path. Rules with a null part are ignored, repeated ones count once, no
    rules leave all to the method. Empty tables give no rows; repeated pages are judged each.
    """
    rows = pages.select(F.col(id_col).alias("page"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    places = rows.select("host", "path").where("host <> ''").distinct()
    known = rules.select("host", "path", "verdict").dropna().distinct()
    known = materialize(known.withColumn("labels", F.size(F.split("host", r"\."))), "rules")
    counts = [r["labels"] for r in known.select("labels").distinct().orderBy("labels").collect()]  # a host has few labels
    labels = F.split("host", r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts]
    none = F.array().cast("array<string>")
    hosts = places.withColumn("suffix", F.explode(F.array_compact(F.array(*suffixes)) if suffixes else none))
    of_host = known.groupBy("host").agg(F.collect_set(F.length("path")).alias("held"))
    found = _looked_up(_digested(hosts, "host", "suffix"), _digested(of_host, "host", "host").select("short", "digest", "held"))
    fits = F.filter("held", lambda n: n <= F.length("path"))
    paths = found.select("host", "path", "suffix", F.explode(fits).alias("n")).select(
        "host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix")
    )
    ruled = F.struct(
        (F.length("host") + F.length("path")).alias("length"),
        F.length("host").alias("host_length"),
        (F.col("verdict") == BLOCK).alias("blocks"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict"),
    )
    whole = known.groupBy("host", "path").agg(F.max(ruled).alias("held"))
    table = _digested(whole, "rule", "host", "path").select("short", "digest", "held")
    best = _looked_up(_digested(paths, "rule", "suffix", "prefix"), table)
    # written, so that the join is of two plain shuffles and a (host, path) of very many pages is split
    best = materialize(best.groupBy("host", "path").agg(F.max("held").alias("best")), "best_rules")
    judged = rows.join(best, ["host", "path"], "left")
    tokens = F.split("host", r"[-._]+")
    shady = F.arrays_overlap(tokens, F.lit(list(host_words))) if host_words else F.lit(False)
    fallback = F.when(shady, BLOCK).otherwise(default)
    return judged.select(
        F.col("page").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", fallback).alias("verdict"),
    )
