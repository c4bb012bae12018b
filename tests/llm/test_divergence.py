import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm import divergence
from tests.llm.conftest import ODD

ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("lang", "source", "text", "digest", "rank")])


def slow(rows, min_docs=3, top=200):
    """All result rows by plain loops."""
    docs, out = [], set()
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = Counter(t for _, _, terms in mine for t in set(terms))
        kept = {t for t, n in found.items() if n >= min_docs}
        times = {s: Counter() for _, s, _ in mine}
        for _, source, terms in mine:
            times[source].update(t for t in terms if t in kept)
        whole = sum(times.values(), Counter())

        def share(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in times.items()}, share(whole)
        for s in times:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in times if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if times[s][t] and p[s][t] > q[t]]
            for part, some, most in (("pair", pairs, None), ("term", terms, top)):
                some = sorted(some, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, n) for n, (item, value) in enumerate(some, 1)}
    return out


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS).repartition(partitions)


def audit(spark, rows, **options):
    found = divergence.audit(table(spark, rows), **options)
    got = found.collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def corpus(seed, sources=4, docs=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("é", "Zu", "ka", "漢", "mo") for b in "abcdefghijk"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(docs):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        rng.shuffle(weights) if i % 40 == 0 else None
        text = " 7-".join(rng.choices(words, weights, k=rng.randint(0, 40)))
        rows.append((rng.choice(["de", "fr", None]), source, text))
    return rows


@pytest.mark.parametrize("bits", [64, 4])
def test_against_plain_loops(spark, bits):
    """With 4 bits nearly every digest is shared by several terms and is split by their strings."""
    rows = corpus(3)
    assert audit(spark, rows, bits=bits, top=7) == slow(rows, top=7)


def test_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(4, sources=7)
    for name, value in (("TILE", 2), ("CELLS", 40), ("HELD", 5), ("SLICE", 3), ("BROADCAST_TERMS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert audit(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = [("en", "s", t) for _, t in ODD] + [(None, None, None), ("", "", ""), ("xx", "only", "1 2 3"), ("xx", "other", None)]
    got = audit(spark, rows)
    assert got == slow(rows)
    assert ("xx", "only", "pair", "other", 0, 1) in got
    assert divergence.audit(table(spark, rows).where(F.lit(False))).count() == 0


def test_large_counts_stay_exact(spark):
    """Shares of counts whose product with 10^9 is beyond 64 bits."""
    n = F.lit(5 * 10**12)
    p = spark.range(1).select(divergence._probability(n, F.lit(7 * 10**12), F.lit(3)).alias("p")).first()["p"]
    assert p == 1 + 10**9 * (5 * 10**12 + 1) // (7 * 10**12 + 3)


def test_strings_are_hashed_before_they_are_compared(docs, monkeypatch):
    """The rows of all tasks are not sorted for the smallest and largest string of a digest."""
    plans, write = {}, divergence.materialize

    def spy(frame, label):
        plans[label] = frame._jdf.queryExecution().sparkPlan().toString()
        return write(frame, label)

    monkeypatch.setattr(divergence, "materialize", spy)
    divergence.kept_terms(divergence._rows(docs([(i, "a b c") for i in range(4)]), "text", "lang", "source"), 3, 64)
    hashed = [x for x in plans["term_strings"].splitlines() if "HashAggregate" in x and "functions=[]" in x]
    assert hashed  # the optimiser leaves the step in
