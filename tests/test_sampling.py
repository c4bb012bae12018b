"""Properties of sampling, balancing and splitting: exact numbers, no loss, no dependence on
partitioning, and the same result on every lookup path."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from prepkit.operators import aggregates as A
from prepkit.operators import sampling as S


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows: a third are copies of one row, the classes are uneven, some are null."""
    i = F.col("id")
    return spark.range(0, 3000, 1, 6).select(
        F.when(i % 3 == 0, -1).otherwise(i).alias("id"),
        F.when(i % 3 == 0, "hot").when(i % 10 == 1, None).when(i % 7 == 0, "rare").otherwise("mid").alias("c"),
        F.when(i % 3 == 0, 0).otherwise(i % 5).alias("v"),
    )


def classes(df):
    return {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}


def test_exact_numbers_with_a_hot_group_of_copies(hot):
    n = classes(hot)
    known = {k: v for k, v in n.items() if k is not None}
    assert classes(S.undersample(hot, "c")) == dict.fromkeys(known, min(known.values()))
    assert classes(S.oversample(hot, "c")) == dict.fromkeys(known, max(known.values()))
    assert classes(S.balance_to_target(hot, "c", 500)) == dict.fromkeys(known, 500)
    assert classes(S.sample_stratified_fraction(hot, "c", 0.3)) == {
        k: int(v * 0.3 + 0.5) for k, v in n.items()
    }
    for size in (1, 1000, 2999, 5000):
        assert S.sample_exact(hot, size).count() == min(size, 3000)


def test_undersample_draws_without_replacement(hot):
    assert not bag(S.undersample(hot, "c")) - bag(hot)
    kept = bag(S.oversample(hot, "c"))
    assert not Counter({k: v for k, v in bag(hot).items() if k[1] is not None}) - kept


@pytest.mark.parametrize("kwargs", [{}, {"exact": True}, {"stratify": "c"}])
@pytest.mark.parametrize("keys", [None, ["id"]])
def test_split_is_disjoint_and_complete(hot, kwargs, keys):
    train, test = S.train_test_split(hot, 0.2, keys=keys, **kwargs)
    assert bag(train) + bag(test) == bag(hot)
    if kwargs.get("exact"):
        assert test.count() == 600
    if "stratify" in kwargs:
        assert classes(test) == {k: int(v * 0.2 + 0.5) for k, v in classes(hot).items()}


def test_repeated_keys_fall_back_to_the_whole_row(hot):
    """``v`` is far from a key: every threshold falls into a large group of equal hashes."""
    assert S.sample_exact(hot, 1234, ["v"]).count() == 1234
    train, test = S.train_test_split(hot, 0.37, keys=["v"], exact=True)
    assert bag(train) + bag(test) == bag(hot) and test.count() == 1110
    assert set(classes(S.undersample(hot, "c", ["v"])).values()) == {
        min(v for k, v in classes(hot).items() if k)
    }


def test_the_same_rows_for_any_partitioning(hot):
    for op in (
        lambda df: S.sample_fraction(df, 0.2),
        lambda df: S.undersample(df, "c", ["id", "v"]),
        lambda df: S.oversample(df, "c"),
        lambda df: S.assign_split(df, 0.3, stratify="c"),
    ):
        assert bag(op(hot.repartition(1))) == bag(op(hot.repartition(8)))


def test_seeds_differ(hot):
    assert bag(S.sample_exact(hot, 500, seed=1)) != bag(S.sample_exact(hot, 500, seed=2))


def test_lookups_beyond_the_broadcast_bound(hot, monkeypatch):
    """Many classes: the class plan is written and joined by shuffle, the result is the same."""
    wide = hot.withColumn("g", F.col("id") % 40)
    want = [
        bag(S.undersample(wide, "g", ["id"])),
        bag(S.assign_split(wide, 0.25, "g")),
        bag(S.sample_stratified_size(wide, "g", 900, ["id"])),
    ]
    written = []
    real = A.materialize
    monkeypatch.setattr(A, "materialize", lambda *a: written.append(a) or real(*a))
    assert bag(S.undersample(wide, "g", ["id"])) == want[0] and not written  # a small plan leaves no file
    monkeypatch.setattr(A.settle, "__defaults__", (5,))
    got = [
        bag(S.undersample(wide, "g", ["id"])),
        bag(S.assign_split(wide, 0.25, "g")),
        bag(S.sample_stratified_size(wide, "g", 900, ["id"])),
    ]
    assert got == want and written


def test_sample_stats(hot):
    some = S.sample_exact(hot, 300)
    assert tuple(S.sample_stats(hot, some).first()) == (3000, 300, 0.1)


def test_bad_arguments(hot):
    with pytest.raises(ValueError):
        S.assign_split(hot, 1.0)
    with pytest.raises(ValueError):
        S.balance_classes(hot, "c", "combine")
