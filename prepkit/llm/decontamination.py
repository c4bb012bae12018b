"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize

BROADCAST_ROWS = 500_000  # longest lookup table that is broadcast; beyond it the join shuffles


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array())


def _windows(w: Column, width: int, made) -> Column:
    """``made(first, others)`` for every run of ``width`` words; an empty array for fewer words."""
    last = F.size(w) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: made(*[F.get(w, i + k) for k in range(width)]))


def shingle_hashes(w: Column, widths: Sequence[int]) -> Column:
    return F.array_distinct(F.concat(*[_windows(w, width, F.xxhash64) for width in widths]))


def shingle_texts(w: Column, widths: Sequence[int]) -> Column:
    return F.array_distinct(F.concat(*[_windows(w, width, lambda *x: F.concat_ws(" ", *x)) for width in widths]))


def _of_item(made, width: int) -> Column:
    """The shingles of an item ``w``: one of its own length if it has fewer words than ``width``."""
    out = made(F.col("w"), [width])
    for n in range(1, width):
        out = F.when(F.size("w") == n, made(F.col("w"), [n])).otherwise(out)
    return out


def sketches(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """``(item, size_class, hash)``: the smallest shingle hashes of each item.

    Items are partitioned by size: class c holds 2^c to 2^(c+1)-1 different shingles. A document
    that contains a share of at least ``threshold`` of n shingles misses at most
    floor((1 - threshold) n) of them, so a sketch of one more, sized for the class's largest n,
    always has a member in the document: the search has no false negatives.
    """
    missing = 1 - Fraction(str(threshold))
    sized = items.select("item", F.array_sort(_of_item(shingle_hashes, width)).alias("h")).where(F.size("h") > 0)
    size_class = F.floor(F.log2(F.size("h") + F.lit(0.5))).cast("int")
    longest = F.expr("shiftleft(2, size_class) - 1")
    misses = F.floor(longest * missing.numerator / missing.denominator + F.lit(1e-9))
    return (
        sized.withColumn("size_class", size_class)
        .withColumn("kept", (misses + 1).cast("int"))
        .select("item", "size_class", F.explode(F.slice("h", 1, F.col("kept"))).alias("hash"))
    )


def _looked_up(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Join to a written lookup table: broadcast if its row count allows, else by shuffle."""
    small = lookup.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(lookup) if small else lookup, on)


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
) -> DataFrame:
    """``(id_col, version, item_col, n_shingles, n_shared, containment)`` of every item found in a document.

    Containment is the share of the item's different shingles (``width`` words, see ``words``)
    that stand anywhere in the whole document; pairs of at least ``threshold`` are returned.
    Sketches of the items propose pairs, over all documents; then all shingles of the proposed
    documents are compared as texts. A document that holds a popular item costs what any other
    does: rows are counted per document, never joined among themselves.

    An item of fewer than ``width`` words is one shingle of its own length, sought among the document's runs
    of as many words. Null and empty texts contain nothing and match nothing.
    ``version`` is Spark's xxhash64 of the text; repeated rows of one id and text are one document, as
    are repeated items of one id and text; items that share an id but not the text are found on their own and
    each gives a row. Null ids are ids.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("body"))
    items = benchmark.select(
        F.struct(F.col(item_col).alias("id"), F.xxhash64(item_text_col).alias("version")).alias("item"),
        words(F.col(item_text_col)).alias("w"),
    ).dropDuplicates(["item"])
    index = materialize(sketches(items, threshold, width), "sketches")
    short = items.where(F.size("w").between(1, width - 1)).select(F.size("w").alias("n")).distinct()
    widths = [width, *sorted(r["n"] for r in short.collect())]  # fewer than ``width`` rows
    probes = rows.select("doc", "version", words(F.col("body")).alias("w")).select(
        "doc", "version", F.explode(shingle_hashes(F.col("w"), widths)).alias("hash")
    )
    hits = _looked_up(probes, index, "hash").select("doc", "version", "item").distinct()
    proposed = materialize(hits, "proposed")

    near = proposed.select("doc", "version").distinct()
    same = F.col("r.doc").eqNullSafe(F.col("n.doc")) & (F.col("r.version") == F.col("n.version"))
    texts = rows.alias("r").join(near.alias("n"), same, "left_semi").select("doc", "version", words(F.col("body")).alias("w"))
    shingles = texts.select("doc", "version", F.explode(shingle_texts(F.col("w"), widths)).alias("shingle")).distinct()
    parts = items.select("item", _of_item(shingle_texts, width).alias("s")).select(
        "item", F.size("s").alias("n_shingles"), F.explode("s").alias("shingle")
    )
    shared = _looked_up(shingles, materialize(parts, "shingles"), "shingle")
    counted = shared.groupBy("doc", "version", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    pair = (
        F.col("c.doc").eqNullSafe(F.col("p.doc"))
        & (F.col("c.version") == F.col("p.version"))
        & F.col("c.item").eqNullSafe(F.col("p.item"))
    )
    share = Fraction(str(threshold))
    enough = F.col("n_shared") * share.denominator >= F.col("n_shingles") * share.numerator
    return (
        counted.where(enough).alias("c")
        .join(proposed.alias("p"), pair, "left_semi")
        .select(
            F.col("doc").alias(id_col),
            "version",
            F.col("item.id").alias(item_col),
            F.col("n_shingles").cast("bigint").alias("n_shingles"),
            "n_shared",
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows, in their own columns, that contain no benchmark item."""
    bad = contained_items(docs, benchmark, id_col, text_col, **options)
    bad = bad.select(F.col(id_col).alias("doc"), "version").distinct()
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("b.doc")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("b.version"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
