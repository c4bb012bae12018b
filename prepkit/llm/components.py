"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; ``root`` is the smallest node reachable.

    Each round hangs larger neighbours below the smallest one known, first from every node's
    whole neighbourhood, then from its smaller neighbours only (Kiveris et al., 2014); the number
    of rounds grows with the logarithm of the longest chain. Minima are pre-aggregated before the
    shuffle and joins are split by adaptive execution, so a component of any size is no hot task.
    Every round is written to the shared folder, and dropped when the next one is. Self-links, repeated links and links with a null
    end are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges, seen = materialize(edges.distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v")
            .unionByName(low.withColumnRenamed("low", "v"))
        )
        before, edges = edges, materialize(small.distinct(), "stars")
        discard(before)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
