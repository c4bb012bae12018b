import random

import xxhash
from pyspark.sql import functions as F

from prepkit.llm import simhash
from prepkit.llm.components import connected_components
from tests.llm.conftest import ODD


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    nodes, root = sorted(nodes), {}
    for n in nodes:
        root[n] = n

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_the_corpus(table, corpus):
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(table("documents")).collect()}
    assert got == {i: signed(slow_fingerprint(t)) for i, t in corpus}


def test_components_of_the_corpus(table, corpus):
    prints = {i: slow_fingerprint(t) for i, t in corpus}
    want = slow_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(table("documents")).collect()}
    assert got == want


def test_family_of_near_copies_is_not_cut(spark):
    """Far more fingerprints on one key than ``crowd``: every link is found, none made up."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    family = {base}
    while len(family) < 400:
        family.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3]))))
    family |= {rng.getrandbits(64) for _ in range(100)}
    prints = [signed(x) for x in family]
    frame = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    got = {(r["a"], r["b"]) for r in simhash.near_links(frame, crowd=8).collect()}
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    assert got == {(a, b) for a in prints for b in prints if a < b and near(a, b)}


def test_masks_cover_every_close_pair():
    rng = random.Random(2)
    for blocks in (4, 16):
        masks = simhash.masks(blocks, 2)
        for _ in range(300):
            diff = signed(sum(1 << b for b in rng.sample(range(64), 2)))
            assert any(diff & m == 0 for m in masks)
    assert len(simhash.masks(4, 2)) == 6 and len(simhash.masks(16, 2)) == 120


def test_long_chain_is_one_component(spark):
    chain = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = connected_components(chain.repartition(7)).collect()
    assert {r["root"] for r in rows} == {0} and len(rows) == 601


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (9, 8)], "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(links).collect()} == {(2, 2), (3, 2), (8, 8), (9, 8)}
    assert connected_components(links.where("false")).count() == 0


def test_odd_rows(docs):
    rows = simhash.near_duplicates(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["component"] for r in rows if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(docs(ODD).where("false")).count() == 0


def test_keep_first(docs, corpus):
    frame = docs(corpus).withColumn("fp", F.lit("mine")).withColumn("version", F.lit(7)).withColumn("id", F.lit(1))
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    found = simhash.near_duplicates(frame)
    assert kept.count() == found.select("component").distinct().count()
    ids = [r["doc_id"] for r in simhash.keep_first(docs(ODD)).select("doc_id").collect()]
    assert ids.count(7) == 1 and 1 in ids and 2 not in ids


def test_result_does_not_depend_on_partitions(docs, corpus):
    a = {tuple(r) for r in simhash.near_duplicates(docs(corpus, 1)).collect()}
    assert a == {tuple(r) for r in simhash.near_duplicates(docs(corpus, 9)).collect()}
