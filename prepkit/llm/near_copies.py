"""Near copies by the Jaccard similarity of word shingles, verified on whole shingle sets.

Pairs are proposed by SimHash fingerprints in pigeonhole blocks, as in ``simhash``, and by a prefix-filtered join for
the pairs whose fingerprints lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepkit.llm.components import connected_components
from prepkit.llm.simhash import SEED, keep_first_of, majority, near_links, shingle_hashes
from prepkit.sources.scratch import discard, materialize

CROWD = 8  # texts that share a shingle before its place in the order matters
ORDER_SHINGLES = 1_000_000  # most common shingles that are ordered by their counts; no result depends on it
ORDER_PART = Fraction(7, 5)  # of a prefix: the part of a text's shingles that is counted
BROADCAST_ROWS = 500_000  # most wanted texts whose addresses are broadcast
BATCH_ROWS = 1000  # texts that a Python worker holds at a time
SLICE = 256  # shingle sets in an Arrow batch
HOT_GROUPS = 64  # components that share a key beyond which its sets are compared in blocks
TILE = 1024  # sets on one side of such a block
SEEDS = (1, 2)  # of the rounds that compare every text of a key with one of them


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` texts for the jobs inside, as shingle sets are larger than their texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted different XXH64 hashes of a UTF-8 text's shingles, of words as ``simhash.fingerprint`` has them.

    A text of fewer than ``width`` words is one shingle; one without words (or null) has none.
    """
    return np.unique(shingle_hashes(text, width).view(np.int64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits, one or two thousand for 500 hashes, each of them the parity of the hashes that fall on it.

    The bits in which two sketches differ are at most as many as the hashes of one set alone. The number
    of words is a power of two, and the exclusive or of both halves is the sketch of half the size.
    """
    words = 1 << max(1, (len(hashes) // 32).bit_length())
    unsigned = hashes.view(np.uint64)
    bits = ((unsigned >> np.uint64(40)) % np.uint64(words)) * np.uint64(64) + (unsigned >> np.uint64(34)) % np.uint64(64)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(n: int, part: Fraction) -> int:
    return n + 1 + (-n * part.numerator // part.denominator) if n else 0


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("binary").alias("text")
    )


def common_shingles(docs: DataFrame, text_col: str, width: int, part: Fraction) -> np.ndarray:
    """The upper 32 bits of shingle hashes that many texts hold, the rarest first, counted over all texts.

    Counted are the shingles that a text lists first as long as nothing is known of them, and some after
    these. Tasks deal their hashes into buckets of 4 bytes a hash; a bucket is counted where it lies,
    and there are enough of them for a bucket to stay small. At most ``ORDER_SHINGLES`` are collected.
    """
    buckets = min(1 << 16, max(64, docs.count() // 2000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), width)
                firsts.append(h[: int(_prefix(len(h), part) * ORDER_PART)])
            upper = (np.concatenate([np.zeros(0, np.int64), *firsts]).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            bucket = upper % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            parts = [x.tobytes() for x in np.split(upper[order], starts[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "h"])

    def count(table: pa.Table) -> pa.Table:
        values, counts = np.unique(np.concatenate([np.frombuffer(h.as_py(), np.uint32) for h in table.column("h")]), return_counts=True)
        many = counts >= CROWD
        return pa.table({"h": pa.array(values[many].astype(np.int64)), "n": pa.array(counts[many])})

    dealt = docs.select(F.col(text_col).cast("binary")).mapInArrow(deal, "bucket int, h binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "h bigint, n bigint")
    most = counted.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    return most.column("h").to_numpy()[::-1].astype(np.uint32)


def prefixes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``(id, version, node, fp, n, plain, prefix, sketch)`` for every row: its shingle set's digest, size, first shingles.

    ``fp`` is the fingerprint of the text, ``simhash.fingerprint`` at this width, from the same hashes.
    Shingles are ordered alike in all texts, common ones last, so the first ``plain`` of a prefix are not
    known to be common. A set of similarity ``threshold`` or more shares at least that part of the n
    shingles, so it misses too few to avoid the first n - ceil(threshold n) + 1.
    """
    part = Fraction(str(threshold))
    common = common_shingles(docs, text_col, width, part)
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], (by_hash + 1).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            nodes, prints, sizes, plains, firsts, sketches = [], [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), width)
                prints.append(majority(hashes))
                h = np.unique(hashes.view(np.int64))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                sketches.append(parity_sketch(h))
                size, plain = _prefix(len(h), part), len(h)
                if len(known) and len(h):
                    upper = (h.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(known, upper), len(known) - 1)
                    place = np.where(known[at] == upper, rank[at], 0)
                    h, plain = h[np.lexsort((h, place))], int((place == 0).sum())
                plains.append(min(plain, size))
                firsts.append(h[:size])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()),
                    pa.array(plains, pa.int32()),
                    pa.array(firsts, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["id", "version", "node", "fp", "n", "plain", "prefix", "sketch"],
            )

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    kinds = "version bigint, node bigint, fp bigint, n int, plain int, prefix array<bigint>, sketch array<bigint>"
    return rows.mapInArrow(run, f"id {kind}, {kinds}")


def _enough(shared: Column, threshold: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles with so many in common are as similar as ``threshold``."""
    part = Fraction(str(threshold))
    return shared * (part.numerator + part.denominator) >= (F.col("n") + F.col("m")) * part.numerator


def _can_follow(threshold: float) -> Column:
    """At the first shingle that two sets share, nothing before it is common and at most the shorter rest is."""
    return _enough(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")), threshold)


def shared_keys(heads: DataFrame) -> DataFrame:
    """``(key, node, n, i)``: prefix shingles that several sets have, written.

    Only shingles that are not known to be common are counted here, and these have few sets each.
    """
    held = heads.select("node", "n", "plain", F.posexplode("prefix").alias("i", "key"))
    rare = held.where("i < plain").select("key", "node", "n", "i")
    rare = rare.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sets > 1").drop("sets")
    return materialize(rare.unionByName(held.where("i >= plain").select("key", "node", "n", "i")), "shared_keys")


def star_proposals(keys: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Pairs ``(a, b, n, m)`` of every set and one other of its key, the same for all sets: one pair a row of ``keys``."""
    one = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    heads = materialize(keys.groupBy("key").agg(F.min(one).alias("one")).select("key", "one.b", "one.m", "one.j"), "leaders")
    met = keys.withColumnRenamed("node", "a").join(heads, "key").where((F.col("a") != F.col("b")) & _can_follow(threshold))
    return _pair(met)


def fingerprint_proposals(heads: DataFrame, threshold: float, distance: int = 2) -> DataFrame:
    """Pairs ``(a, b, n, m)`` of sets whose fingerprints differ in at most ``distance`` bits, found by pigeonhole blocks.

    Every set meets one set of its own fingerprint, and that one a set of the smallest fingerprint near its
    own: at most one pair a set, however large a family is.
    """
    prints = heads.where("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("one"))
    prints = materialize(prints.select("fp", F.col("one.node").alias("b"), F.col("one.n").alias("m")), "fingerprints")
    same = heads.select("fp", F.col("node").alias("a"), "n").join(prints, "fp").where("a <> b").select("a", "b", "n", "m")
    near = near_links(prints.select("fp"), distance).groupBy("b").agg(F.min("a").alias("near")).select(F.col("b").alias("fp"), "near")
    one = prints.select("fp", F.col("b").alias("a"), F.col("m").alias("n")).join(near, "fp")
    near = one.join(prints.withColumnRenamed("fp", "near"), "near").select("a", "b", "n", "m")
    return _pair(same.unionByName(near).where(_enough(F.least("n", "m"), threshold)))


def _pair(met: DataFrame) -> DataFrame:
    least = F.least("a", "b")
    first = F.col("a") == least
    sizes = F.when(first, F.col("n")).otherwise(F.col("m")), F.when(first, F.col("m")).otherwise(F.col("n"))
    return met.select(least.alias("a"), F.greatest("a", "b").alias("b"), sizes[0].alias("n"), sizes[1].alias("m")).distinct()


def cross_proposals(keys: DataFrame, found: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, n, m)`` that share a key and lie in different components, so that a family yields none.

    Keys meet by their components first; only keys of several components bring their sets along, and
    those of very many have them compared in blocks.
    """
    placed = keys.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = materialize(placed.select("key", "node", "n", "i", F.coalesce("root", "node").alias("root")), "placed_keys")
    groups = placed.select("key", "root").distinct()
    several = groups.groupBy("key").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1")
    several = materialize(several, "several")
    groups = materialize(groups.join(several.where(F.col("roots") <= HOT_GROUPS).select("key"), "key"), "key_components")
    r, s = (groups.select("key", F.col("root").alias(name)) for name in ("r", "s"))
    apart = r.join(s, "key").where("r < s")
    left = placed.select(F.col("key"), F.col("root").alias("r"), F.col("node").alias("a"), "n", "i")
    right = placed.select(F.col("key"), F.col("root").alias("s"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    few = apart.join(left, ["key", "r"]).join(right, ["key", "s"]).where(_can_follow(threshold))
    few = few.select("a", "b", "n", "m", "i", "j")
    hot = several.where(F.col("roots") > HOT_GROUPS)
    return _pair(few.unionByName(_hot_proposals(placed.join(hot, "key"), heads, threshold)))


def _hot_proposals(rows: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n, m, i, j)`` of keys that very many components share, which sketches let be similar.

    A key's sets are dealt into tiles, and each pair of tiles is compared in one small task, so that
    pairs that are not near leave no row anywhere and no task holds more than two tiles.
    """
    part = Fraction(str(threshold))
    tiles = F.ceil(F.col("sets") / TILE).cast("int")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).select("key", tiles.alias("tiles"))
    dealt = rows.join(materialize(sizes, "hot_keys"), "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.join(heads.select("node", "sketch"), "node").select(
        "key", "node", "root", "n", "i", "sketch", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")
    )

    def near(table: pa.Table) -> pa.Table:
        node, root, n, i, tile = (table.column(c).to_numpy() for c in ("node", "root", "n", "i", "tile"))
        sketch = table.column("sketch").combine_chunks()
        words = np.diff(sketch.offsets.to_numpy())
        flat, starts = sketch.values.to_numpy().view(np.uint64), sketch.offsets.to_numpy()[:-1]
        one = table.column("ti")[0].as_py()
        out: list[tuple] = []
        for size in np.unique(words):
            mine = np.flatnonzero((words == size) & (tile == one))
            # sketches of as many words, and of twice as many, folded; both ways if the tiles differ
            for more in (size, 2 * size, size // 2):
                rest = np.flatnonzero(words == more)
                if one != table.column("tj")[0].as_py():
                    rest = rest[tile[rest] != one]
                elif more < size:
                    continue
                if not len(rest) or not more:
                    continue
                width = int(min(size, more))
                held = flat[starts[rest][:, None] + np.arange(more)].reshape(len(rest), -1, width)
                held = np.bitwise_xor.reduce(held, axis=1)
                for row in mine:
                    sketch_ = np.bitwise_xor.reduce(flat[starts[row] + np.arange(size)].reshape(-1, width), axis=0)
                    apart = np.bitwise_count(held ^ sketch_).sum(axis=1, dtype=np.int64)
                    both = n[row].astype(np.int64) + n[rest]
                    least = np.minimum(n[row] - i[row], n[rest] - i[rest])
                    whole = part.numerator + part.denominator
                    good = (root[rest] != root[row]) & ((both - apart) * whole >= 2 * both * part.numerator)
                    good &= least * whole >= both * part.numerator
                    out += [(node[row], node[k], n[row], n[k], i[row], i[k]) for k in rest[good]]
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table({c: pa.array([int(x) for x in v], t) for c, v, t in zip("abnmij", columns, kinds)})

    return dealt.groupBy("key", "ti", "tj").applyInArrow(near, "a bigint, b bigint, n int, m int, i int, j int")


def _sketches_allow(threshold: float) -> Column:
    """Whether the sketches ``x`` and ``y`` let sets of ``n`` and ``m`` shingles be similar enough; loses no pair that is."""
    size = F.least(F.size("x"), F.size("y"))

    def folded(sketch: Column) -> Column:
        half = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(sketch, i).bitwiseXOR(F.get(sketch, i + size)))
        return F.when(F.size(sketch) == 2 * size, half).otherwise(sketch)

    bits = F.zip_with(folded(F.col("x")), folded(F.col("y")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda total, b: total + b)
    part = Fraction(str(threshold))
    least = 2 * (F.col("n") + F.col("m")) * part.numerator
    close = (F.col("n") + F.col("m") - apart) * (part.numerator + part.denominator) >= least
    return (F.greatest(F.size("x"), F.size("y")) > 2 * size) | close  # sketches further apart are not folded


def verified(
    pairs: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float
) -> DataFrame:
    """The proposed pairs ``(a, b)`` whose Jaccard similarity is ``threshold`` or more, by their whole shingle sets.

    Sketches, which are small, reject nearly all others first. Only the texts of what is left are read
    again, one for each set.
    """
    sketches = heads.select("node", "sketch")
    likely = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b").where(_sketches_allow(threshold))
    likely = materialize(likely.select("a", "b", "n", "m"), "likely")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(heads.join(ends, "node", "left_semi").select("node", "at.id", "at.version"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.version") == F.col("w.version"))
    texts = _rows(docs, id_col, text_col).alias("d").join(side.alias("w"), same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                sets = [shingle_set(text.as_py(), width) for text in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])

    sets = materialize(texts.mapInArrow(run, "node bigint, h array<bigint>").dropDuplicates(["node"]), "sets")
    first = likely.join(sets.toDF("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    same = first.join(sets.toDF("b", "y"), "b").where(_enough(shared, threshold)).select("a", "b")
    same = materialize(same, "links")
    discard(likely, wanted, sets)
    return same


def linked_sets(
    docs: DataFrame, heads: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``(node, root)``: components of the sets under links of similarity ``threshold`` or more; all that have one.

    Sets are first compared with a set of their own or a near fingerprint and with one set of each of
    their keys, then with another one of each key: that joins a family of copies for as many pairs as it
    has keys. Then every pair that shares a key and is not in one component yet is compared, so that no
    link between two components is missed.
    """
    keys = shared_keys(heads)
    found = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    for seed in (*SEEDS, None):
        if seed is None:
            pairs = cross_proposals(keys, found, heads, threshold)
        else:
            pairs = star_proposals(keys, threshold, seed)
            if seed == SEEDS[0]:
                pairs = pairs.unionByName(fingerprint_proposals(heads, threshold)).distinct()
            else:
                met = pairs.join(found.toDF("a", "r"), "a", "left").join(found.toDF("b", "s"), "b", "left")
                pairs = met.where(~F.coalesce(F.col("r") == F.col("s"), F.lit(False))).select("a", "b", "n", "m")
        pairs = materialize(pairs, "proposals")
        more = verified(pairs, heads, docs, id_col, text_col, width, threshold)
        known, before = more.unionByName(found.where("node <> root").toDF("a", "b")), found
        found = materialize(connected_components(known), "components")
        discard(pairs, more, before)
    discard(keys)
    return found


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``(id_col, version, family, component)``: every row with its group and the smallest id of it.

    Rows link when the Jaccard similarity of their different ``width``-word shingles is at least
    ``threshold``; groups are closed over chains of links. Equal shingle sets, also the empty one, are
    collapsed first. Repeated and null ids are as in ``simhash.near_duplicates``. A very long text is one
    set like any other, held whole in the task that reads it; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        prints = materialize(prefixes(docs, id_col, text_col, width, threshold), "prints")
        heads = prints.groupBy("node").agg(
            F.min("id").alias("first"),
            F.min(F.struct("id", "version")).alias("at"),
            F.min("fp").alias("fp"),  # sets of repeated shingles may have several
            *[F.first(c).alias(c) for c in ("n", "plain", "prefix", "sketch")],
        )
        heads = materialize(heads, "heads")
        found = linked_sets(docs, heads, id_col, text_col, width, threshold)
    rooted = heads.select("node", "first").join(found, "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("family")
    )
    # only sets that were linked meet in a group of their family
    linked = rooted.where("family <> node").select("family").distinct()
    smallest = rooted.join(linked, "family").groupBy("family").agg(F.min("first").alias("least"))
    named = rooted.join(smallest, "family", "left").select("node", "family", F.coalesce("least", "first").alias("component"))
    return prints.select("id", "version", "node").join(named, "node").select(
        F.col("id").alias(id_col), "version", "family", "component"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, in their own columns, with one row of each group of near copies, as ``simhash.keep_first`` picks it."""
    return keep_first_of(docs, near_copies(docs, id_col, text_col, **options), id_col, text_col)
