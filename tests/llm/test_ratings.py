import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm import ratings
from tests.llm.conftest import ODD


def rated(docs, n=600):
    """Three grades: two bad words, one, none; the rest of the words tells nothing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(20, 80))]
        grade = int(rng.integers(3))
        for bad in ["awful", "dreadful"][: 2 - grade]:
            words.insert(int(rng.integers(len(words))), bad)
        rows.append((i, " ".join(words), grade))
    grades = {i: g for i, _, g in rows}
    frame = docs([(i, t) for i, t, _ in rows])
    lookup = F.create_map(*[F.lit(x) for i, g in grades.items() for x in (i, g)])
    return frame.withColumn("grade", F.element_at(lookup, F.col("doc_id").cast("int"))), grades


def test_held_out_grades(docs):
    frame, grades = rated(docs)
    model = ratings.train(frame, frame.where("doc_id < 400"), 3, shard_rows=150)
    assert model.cuts[0] < model.cuts[1]
    rows = ratings.rate(frame.where("doc_id >= 400"), model).collect()
    assert sum(r["kept"] == (grades[r["doc_id"]] == 2) for r in rows) >= 0.95 * len(rows)
    mean = [np.mean([r["expected_grade"] for r in rows if grades[r["doc_id"]] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r["tail"] <= 1 and r["tail"] <= r["expected_grade"] <= 2 for r in rows)


def test_probabilities_by_hand():
    model = ratings.OrdinalModel(np.array([1.0, -2.0]), np.array([-1.0, 1.0]))
    above = model.above(np.array([0.0, 3.0]))
    assert np.allclose(above[0], [1 - 1 / (1 + np.exp(1)), 1 - 1 / (1 + np.exp(-1))])
    assert (above[1] > above[0]).all() and model.grades == 3


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    buckets = [rng.integers(0, 50, 8) for _ in range(200)]
    values = [np.ones(8)] * 200
    truth = rng.normal(size=50)
    score = np.array([truth[b].sum() for b in buckets])
    grades = np.digitize(score, np.quantile(score, [0.3, 0.7]))

    def loss(m):
        s = np.array([m.weights[b].sum() for b in buckets])
        p = np.concatenate([np.ones((200, 1)), m.above(s), np.zeros((200, 1))], axis=1)
        return -np.log(p[np.arange(200), grades] - p[np.arange(200), grades + 1] + 1e-12).mean()

    start = ratings.OrdinalModel(np.zeros(50), np.array([-0.8, 0.8]))
    fitted, _ = ratings.fit_shard(buckets, values, grades, start, 10, 0.2, 0)
    assert loss(fitted) < 0.6 * loss(start) and (np.diff(fitted.cuts) > 0).all()


def test_fit_does_not_depend_on_partitions(docs):
    frame, _ = rated(docs, 200)
    a = ratings.train(frame.repartition(1), frame, 3, shard_rows=60)
    b = ratings.train(frame.repartition(7), frame.repartition(5), 3, shard_rows=60)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.cuts, b.cuts)


def test_odd_rows(docs):
    frame, _ = rated(docs, 100)
    model = ratings.train(frame, frame, 3)
    rows = ratings.rate(docs(ODD).withColumn("tail", F.lit(1)), model).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r["expected_grade"]) for r in rows)
    assert ratings.rate(docs(ODD).where("false"), model).count() == 0
    untaught = ratings.train(frame, frame.withColumn("grade", F.lit(None).cast("int")), 3)
    assert not untaught.weights.any() and ratings.rate(docs(ODD), untaught).count() == len(ODD)
    odd = docs(ODD).withColumn("grade", F.lit(9))
    assert not ratings.train(odd, odd, 3).weights.any()


def slow_features(text, buckets):
    """The features one by one: {bucket: value} of words, and the list of sign buckets."""
    low = text.lower().split()
    words = {zlib.crc32(f"w {w.strip(string.punctuation)}".encode()) % buckets for w in set(low)}
    lines = text.split("\n")
    size = max(1, len(text))
    facts = {
        "words": len(low).bit_length(),
        "symbols": min(10, int(40 * sum(c in ratings._SYMBOLS for c in text) / size)),
        "capitals": int(10 * sum("A" <= c <= "Z" for c in text) / size),
        "lines": int(10 * (1 - len(set(lines)) / len(lines))),
        "different": int(10 * len(set(low)) / max(1, len(low))),
        "word": min(20, size // max(1, len(low))),
    }
    signs = [zlib.crc32(f"s {k} {v}".encode()) % buckets for k, v in facts.items()]
    return {b: max(1, len(words)) ** -0.25 for b in words}, signs


def test_features_one_by_one(corpus):
    made = ratings.Featurizer(1 << 17)
    for _, text in [*corpus, *((i, t or "") for i, t in ODD)]:
        index, values = made(text)
        words, signs = slow_features(text or "", 1 << 17)
        assert dict(zip(index[: len(words)].tolist(), values[: len(words)])) == pytest.approx(words)
        assert index[len(words) :].tolist() == signs and (values[len(words) :] == 1).all()


def full_batch(x, grades, steps=1000, rate=0.1):
    """Cumulative-link regression by plain gradient descent over all rows at once."""
    w, cuts = np.zeros(x.shape[1]), np.array([-0.7, 0.7])
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        below = np.concatenate([[-np.inf], cuts, [np.inf]])
        score = x @ w
        low, high = sig(below[grades] - score), sig(below[grades + 1] - score)
        w -= rate * x.T @ (1 - low - high) / len(grades)
        width = np.maximum(high - low, 1e-9)
        for k in range(2):
            pull = (low * (1 - low) / width)[grades == k + 1].sum() - (high * (1 - high) / width)[grades == k].sum()
            cuts[k] -= rate * pull / len(grades)
    return w, cuts


def test_agrees_with_a_full_batch_fit(docs):
    """Held-out selection as an independent fit over exact word features gives it, and nearly its loss."""
    frame, grades = rated(docs)
    model = ratings.train(frame, frame.where("doc_id < 400"), 3, shard_rows=150)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    words = sorted({w for t in texts.values() for w in t.split()})
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(texts), len(words)))
    for i, t in texts.items():
        x[i, [at[w] for w in set(t.split())]] = 1
    truth = np.array([grades[i] for i in range(len(texts))])
    w, cuts = full_batch(x[:400], truth[:400])
    slow = ratings.OrdinalModel(w, cuts).above(x[400:] @ w)
    rows = {r["doc_id"]: r for r in ratings.rate(frame.where("doc_id >= 400"), model).collect()}
    expected = np.array([rows[i]["expected_grade"] for i in range(400, len(texts))])
    assert np.corrcoef(expected, slow.sum(axis=1))[0, 1] >= 0.9
    tail = np.array([rows[i]["tail"] for i in range(400, len(texts))])
    assert ((tail >= 0.5) == (slow[:, -1] >= 0.5)).mean() >= 0.9
    loss = lambda p: -np.log(np.clip(np.where(truth[400:] == 2, p, 1 - p), 1e-6, 1)).mean()
    assert loss(tail) <= loss(slow[:, -1]) + 0.2
