"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.llm.components import connected_components
from prepkit.sources.scratch import materialize

BITS = 64
SEED = 42
_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of one UTF-8 text: bit by bit, what over half of its shingle hashes hold.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is ``width``
    words joined by single spaces, repeats included, hashed by XXH64. A text of fewer words is one
    shingle; a text without words (or null) has fingerprint zero.
    """
    hashes = shingle_hashes(text, width)
    return majority(hashes) if len(hashes) else 0


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The XXH64 hashes of a UTF-8 text's shingles, in order, repeats included; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - width + 1)]
    ends = ends[min(width, len(words)) - 1 :]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half of the hashes hold."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        some = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id_col, version, fp)`` for every row: the fingerprint of its whole text, a signed 64-bit integer.

    ``version`` is Spark's xxhash64 of the text, which tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(signed)], names=["id", "version", "fp"]
            )

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("version")
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, version bigint, fp bigint").withColumnRenamed("id", id_col)


def masks(blocks: int, distance: int) -> list[int]:
    """Signed masks that each keep all but ``distance`` of ``blocks`` equal runs of bits.

    Two fingerprints that differ in at most ``distance`` bits differ in at most that many blocks,
    so they agree under at least one mask.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    full = (1 << BITS) - 1
    kept = [full - sum(drop) for drop in combinations(runs, distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in kept]


def _keyed(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    keys = [
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks(blocks, distance))
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.key", "fp")


def _pairs(keyed: DataFrame, distance: int) -> DataFrame:
    a = keyed.withColumnRenamed("fp", "a")
    b = keyed.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_links(
    prints: DataFrame, distance: int = 2, blocks: int = 4, fine_blocks: int = 16, crowd: int = 64
) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Pigeonhole: with ``blocks`` runs of bits, close fingerprints agree in all but ``distance`` of
    them; they meet on that key and the Hamming distance of each meeting is verified. Keys that
    gather more than ``crowd`` fingerprints (a family of near copies) are not joined as they are:
    their members are keyed anew by ``fine_blocks``, where the free bits are so few (eight) that a
    key can never hold more than 256 fingerprints. So no group yields all its pairs, and none is cut.
    """
    keyed = _keyed(prints, blocks, distance)
    sizes = keyed.groupBy("mask", "key").count().where("count > 1")
    shared = materialize(keyed.join(sizes, ["mask", "key"]), "blocks")
    crowded = shared.where(F.col("count") > crowd).select("fp").distinct()
    near = _pairs(shared.where(F.col("count") <= crowd).drop("count"), distance)
    close = _pairs(_keyed(crowded, fine_blocks, distance), distance)
    return near.unionByName(close).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2
) -> DataFrame:
    """``(id_col, version, fp, family, component)``: every row with its fingerprint and the smallest id it is linked to.

    Rows link when their fingerprints differ in at most ``distance`` bits; components are closed
    over chains of links, and ``family`` is the least fingerprint among them. Exact copies and equal fingerprints are collapsed first (with map-side
    combining), so links are sought between different fingerprints only. Repeated ids are rows
    of their own; null ids count as no candidate for the smallest id (a component of null ids
    only has a null component). An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    first = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    found = connected_components(near_links(first.select("fp"), distance))
    rooted = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    linked = rooted.where("root <> fp").select("root").distinct()
    smallest = rooted.join(linked, "root").groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root", "left").select(
        "fp", F.col("root").alias("family"), F.coalesce("component", "first").alias("component")
    )
    return prints.join(named, "fp").select(id_col, "version", "fp", "family", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, in their own columns, with one row of each group of near duplicates: the smallest id's.

    Where several rows of a group have that id, the one of the least ``version`` stays, and of
    rows equal in id and text any one; a group of null ids only keeps one row.
    """
    return keep_first_of(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def keep_first_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_first`` for groups that are known: ``(id_col, version, family, component)`` of every row."""
    first = found.where(F.col(id_col).eqNullSafe(F.col("component"))).withColumnRenamed(id_col, "id")
    first = materialize(first.groupBy("family", "id").agg(F.min("version").alias("version"), F.count("*").alias("n")), "first")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")) & (F.xxhash64(f"d.{text_col}") == F.col("f.version"))
    alone = docs.alias("d").join(first.where("n = 1").alias("f"), same, "left_semi")
    if first.where("n > 1").isEmpty():
        return alone
    several = docs.alias("d").join(first.where("n > 1").alias("f"), same, "left_semi")
    return alone.unionByName(several.dropDuplicates([id_col, text_col]))


def hex_string(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
