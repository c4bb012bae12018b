import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from prepkit.llm import near_copies, simhash
from tests.llm.conftest import ODD
from tests.llm.test_simhash import slow_components


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b):
    return a == b or len(a & b) * 5 >= 4 * len(a | b)


def slow(rows):
    """The smallest id of each row's group, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    return slow_components(sets, lambda a, b: similar(sets[a], sets[b]))


def family(rng, size, words=240):
    """Copies of one text with a few words changed, some of them shortened."""
    base, out = [f"w{rng.randrange(3000)}" for _ in range(words)], []
    for _ in range(size):
        copy = list(base)
        for at in rng.sample(range(words), rng.randint(0, 6)):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy[rng.choice([0, 0, 10, 60]) :]))
    return out


def test_stage_drops_near_copies_beyond_two_bits(spark, sf_dir, docs):
    rng = random.Random(31)
    texts = [t for _ in range(12) for t in family(rng, 6)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(texts))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), sf_dir).collect()}
    assert kept == set(slow(rows).values())
    far = [
        (a, b) for a, b in combinations(texts, 2)
        if similar(shingles(a), shingles(b)) and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 2
    ]
    assert far


def test_groups_of_the_corpus(table, corpus):
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(table("documents")).collect()}
    assert got == slow(corpus)


def test_links_at_the_threshold(docs):
    """Small sets of a small vocabulary around similarity 0.8, exactly 0.8 among them; a hot family too."""
    rng = random.Random(37)
    pool = [f"p{i}" for i in range(16)]
    rows = [(i, " ".join(rng.sample(pool, rng.randint(5, 12)))) for i in range(150)] + list(enumerate(family(rng, 40, 60), 1000))
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i")]  # 4 of 5 shingles
    frame = docs(rows)
    for width in (1, 5):
        sets = {i: shingles(t, width) for i, t in rows}
        want = slow_components(sets, lambda a, b: similar(sets[a], sets[b]))
        got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(frame, width=width).collect()}
        assert got == want
    assert got[2001] == 2000


def test_result_does_not_depend_on_order_or_broadcasts(docs, corpus, monkeypatch):
    want = slow(corpus)
    for values in ({"ORDER_SHINGLES": 0, "BROADCAST_ROWS": 0, "SEEDS": ()}, {"CROWD": 1, "SLICE": 2, "HOT_GROUPS": 1, "TILE": 3, "SEEDS": ()}):
        for name, value in values.items():
            monkeypatch.setattr(near_copies, name, value)
        assert {r["doc_id"]: r["component"] for r in near_copies.near_copies(docs(corpus)).collect()} == want


def test_sketches_lose_no_pair():
    """Differing bits are at most the differing shingles, also where one sketch is folded."""
    rng = np.random.default_rng(41)
    for size in (3, 31, 33, 500, 1020, 5000):
        for changed in (0, 1, size // 9, size // 3):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
            b = np.unique(np.concatenate([a[changed:], rng.integers(-(2**63), 2**63 - 1, changed // 4)]))
            x, y = sorted((near_copies.parity_sketch(a), near_copies.parity_sketch(b)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            weight = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert weight <= len(np.setxor1d(a, b))
            assert changed or weight == 0


def test_sketches_reject_before_texts_move(spark, docs):
    """Texts that share their rarest shingle and little else are proposed, and rejected by sketches alone."""
    rng = random.Random(43)
    rows = [(i, " ".join([*"abcde", *(f"w{rng.randrange(10**6)}" for _ in range(60))])) for i in range(30)]
    rows += [(100 + i, t) for i, t in enumerate(family(rng, 5))]
    frame = docs(rows)
    heads = near_copies.prefixes(frame).withColumn("at", F.struct("id", "version")).dropDuplicates(["node"])
    pairs = [(r["a"], r["b"]) for r in heads.alias("x").join(heads.alias("y"), F.col("x.node") < F.col("y.node")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).collect()]
    sizes = {r["node"]: r["n"] for r in heads.collect()}
    pairs = [(a, b) for a, b in pairs if 0.8 <= sizes[a] / sizes[b] <= 1.25]
    given = spark.createDataFrame([(a, b, sizes[a], sizes[b]) for a, b in pairs], "a bigint, b bigint, n int, m int")
    sketches = heads.select("node", "sketch")
    likely = given.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b").where(near_copies._sketches_allow(0.8))
    true = near_copies.verified(given, heads, frame, "doc_id", "text", 5, 0.8)
    assert true.count() <= likely.count() <= 10 < 400 < len(pairs)


def test_families_yield_few_pairs(docs):
    """150 copies of one text: what is compared grows with their number, not with its square."""
    rng = random.Random(47)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    heads = near_copies.prefixes(docs(rows)).withColumn("at", F.struct("id", "version"))
    keys = near_copies.shared_keys(heads)
    first = near_copies.star_proposals(keys, 0.8, 1)
    assert first.count() <= 10 * len(rows)
    found = near_copies.linked_sets(docs(rows), heads)
    assert found.select("root").distinct().count() == 1
    assert near_copies.cross_proposals(keys, found, heads, 0.8).count() == 0


def test_fingerprints_propose_pairs(spark, docs, sf_dir, monkeypatch):
    """Texts within two bits meet by their fingerprints, at most one pair a set, also where no shingle proposes them."""
    rng = random.Random(59)
    rows = []
    for f in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(2000)]
        for i in range(12):
            copy = list(base)
            copy[rng.randrange(2000)] = f"x{i}"
            rows.append((100 * f + i, " ".join(copy)))
    heads = near_copies.prefixes(docs(rows)).withColumn("at", F.struct("id", "version"))
    of = {r["id"]: r for r in heads.collect()}
    assert all(of[i]["fp"] % (1 << 64) == simhash.fingerprint(t.encode(), 5) for i, t in rows)
    fps = {r["node"]: r["fp"] for r in of.values()}
    near = lambda a, b: ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 2
    pairs = {(r["a"], r["b"]) for r in near_copies.fingerprint_proposals(heads, 0.8).collect()}
    assert pairs and len(pairs) <= len(rows) and all(near(a, b) for a, b in pairs)
    met = {x for pair in pairs for x in pair}
    assert met == {a for a in fps if any(a != b and near(a, b) for b in fps)}
    none = spark.range(0).selectExpr("id AS a", "id AS b", "CAST(id AS int) AS n", "CAST(id AS int) AS m")
    monkeypatch.setattr(near_copies, "star_proposals", lambda *args: none)
    monkeypatch.setattr(near_copies, "cross_proposals", lambda *args: none)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(rows), sf_dir).count()
    assert kept == len(rows) - len(pairs)  # links by the least near fingerprint form no circle


def test_hot_keys_lose_no_link(docs, monkeypatch):
    """A family around the threshold, most of it below, compared in blocks of a few sets: the same groups as all pairs."""
    rng = random.Random(53)
    base = [f"w{rng.randrange(3000)}" for _ in range(70)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(70), rng.randint(0, 3)):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy[: rng.choice([70, 66])])))
    want = slow(rows)
    assert 1 < len(set(want.values())) < 60
    for name, value in (("SEEDS", ()), ("HOT_GROUPS", 1), ("TILE", 7)):
        monkeypatch.setattr(near_copies, name, value)
    assert {r["doc_id"]: r["component"] for r in near_copies.near_copies(docs(rows)).collect()} == want


def test_names_of_helpers_may_be_columns(docs):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "z")]
    frame = docs(rows)
    for name in ("node", "id", "version", "h", "n", "sketch", "key"):
        frame = frame.withColumn(name, F.lit("mine"))
    kept = near_copies.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_odd_rows(docs):
    rows = near_copies.near_copies(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    ids = [r["doc_id"] for r in near_copies.keep_first(docs(ODD).withColumn("n", F.lit(7))).collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and 1 in ids and 2 not in ids
    assert near_copies.keep_first(docs(ODD).where("false")).count() == 0
