"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize

_REMEMBERED = 400_000  # words whose bucket a worker keeps
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
_SYMBOLS = "#*$%&|<>!"


class Featurizer:
    """The hashed features of a text: its different words, and a few signs of its shape.

    Words are lower-cased and without ASCII punctuation at their ends; every different word has
    the value n ** -0.25, n being their number. Signs (magnitude of the length, shares of symbols, capitals,
    repeated lines and different words, mean word length, each in a few steps) are words of their
    own with the value one. All share one space of ``buckets`` weights.
    """

    def __init__(self, buckets: int):
        self.buckets, self._known = buckets, {}

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "replace")) % self.buckets

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        different, known = set(words), self._known
        if len(known) > _REMEMBERED:
            known.clear()
        for word in different.difference(known):
            known[word] = self.bucket("w " + word.strip(_EDGES))
        own = np.unique(np.fromiter((known[w] for w in different), np.int64, len(different)))
        signs = np.fromiter((self.bucket(s) for s in self.signs(text, len(words), len(different))), np.int64)
        values = np.concatenate([np.full(len(own), max(1, len(own)) ** -0.25), np.ones(len(signs))])
        return np.concatenate([own, signs]), values

    @staticmethod
    def signs(text: str, words: int, different: int) -> list[str]:
        codes = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        size, lines = max(1, len(text)), text.split("\n")
        capitals = int(((codes >= 65) & (codes <= 90)).sum())
        symbols = sum(text.count(c) for c in _SYMBOLS)
        return [
            f"s words {words.bit_length()}",
            f"s symbols {min(10, int(40 * symbols / size))}",
            f"s capitals {int(10 * capitals / size)}",
            f"s lines {int(10 * (1 - len(set(lines)) / len(lines)))}",
            f"s different {int(10 * different / max(1, words))}",
            f"s word {min(20, size // max(1, words))}",
        ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - weights . x): one weight vector, ordered thresholds."""

    weights: np.ndarray
    cuts: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.cuts) + 1

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a row per score and a column per threshold."""
        return 1 - _sigmoid(self.cuts[None, :] - scores[:, None])


def fit_shard(
    buckets: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, model: OrdinalModel, epochs: int, rate: float, seed: int
) -> tuple[OrdinalModel, np.ndarray]:
    """Passes of AdaGrad over some rows, from a given model; also the squared gradients by bucket."""
    weights, cuts = model.weights.copy(), model.cuts.copy()
    power, cut_power = np.zeros(len(weights)), np.full(len(cuts), 1e-8)
    rows = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rows.permutation(len(grades))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            index = np.concatenate([buckets[i] for i in some])
            value = np.concatenate([values[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(buckets[i]) for i in some])
            score = np.bincount(doc, weights[index] * value, len(some))
            below = np.concatenate([[-np.inf], cuts, [np.inf]])
            low, high = _sigmoid(below[grades[some]] - score), _sigmoid(below[grades[some] + 1] - score)
            low[grades[some] == 0], high[grades[some] == len(cuts)] = 0.0, 1.0
            slope = 1 - low - high  # of the loss by the score
            touched, inverse = np.unique(index, return_inverse=True)
            step = np.bincount(inverse, slope[doc] * value, len(touched))
            power[touched] += step**2
            weights[touched] -= rate * step / np.sqrt(power[touched] + 1e-8)
            width = np.maximum(high - low, 1e-9)
            pull = np.bincount(grades[some], low * (1 - low) / width, len(cuts) + 1)[1:]
            push = np.bincount(grades[some], high * (1 - high) / width, len(cuts) + 1)[:-1]
            cut_power += (pull - push) ** 2
            cuts -= 0.3 * rate * (pull - push) / np.sqrt(cut_power)
            cuts = np.maximum.accumulate(cuts + 1e-4 * np.arange(len(cuts))) - 1e-4 * np.arange(len(cuts))
    return OrdinalModel(weights, cuts), power


def informative(counts: np.ndarray, rows: np.ndarray, min_rows: int, min_z: float) -> np.ndarray:
    """Which buckets tell grades apart: ``counts`` (grade, bucket) of ``rows`` (grade) rows.

    A bucket is used if at least ``min_rows`` rows have it and their number at or below some grade is at least
    ``min_z`` standard deviations from what chance would give. Words that few rows have would
    only be learnt by heart.
    """
    held, used = counts.sum(axis=0), np.zeros(counts.shape[1], bool)
    for k in range(len(rows) - 1):
        share = rows[: k + 1].sum() / max(1.0, rows.sum())
        spread = np.sqrt(held * share * (1 - share) + 1)
        used |= np.abs(counts[: k + 1].sum(axis=0) - held * share) >= min_z * spread
    return used & (held >= min_rows)


def _fitter(start: OrdinalModel, used: np.ndarray, epochs: int, rate: float, seed: int):
    """A function for ``applyInPandas`` that fits one shard from a model; cuts have negative buckets."""

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["place", "grade"], ignore_index=True)
        buckets, values = [], []
        for b, v in zip(shard["buckets"], shard["vals"]):
            kept = used[b] | (v == 1)  # signs always count
            buckets.append(np.asarray(b, np.int64)[kept]), values.append(v[kept])
        grades = shard["grade"].to_numpy(np.int64)
        found, power = fit_shard(buckets, values, grades, start, epochs, rate, seed)
        seen, cuts = np.flatnonzero(power), -1 - np.arange(len(found.cuts))
        return pd.DataFrame(
            {
                "bucket": np.concatenate([seen, cuts]),
                "learnt": np.concatenate([power[seen], np.full(len(cuts), float(len(shard)))]),
                "value": np.concatenate([found.weights[seen], found.cuts]),
            }
        )

    return fit


def train(
    docs: DataFrame,
    marks: DataFrame,
    grades: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    buckets: int = 1 << 17,
    max_rows: int = 24_000,
    shard_rows: int = 3_000,
    rounds: int = 3,
    epochs: int = 3,
    rate: float = 0.5,
    min_rows: int = 5,
    min_z: float = 3.0,
) -> OrdinalModel:
    """Fit on the texts of ``docs`` that ``marks`` (id, grade) gives a grade in 0 .. ``grades`` - 1.

    Other grades and marks without a text are left out; equal marks and texts of one id count once
    (the one whose features sort first), different grades each. At most about ``max_rows`` marks,
    chosen by a hash, are learnt from: the bound is a parameter of the fit, and it is what lets the
    marks be broadcast to the texts, which are not shuffled.

    Features are made once, and buckets that do not tell grades apart are left out (see
    ``informative``; the counts that decide it are a row per bucket and grade). In each round shards
    of about ``shard_rows`` rows are fitted in parallel from the common model, and their weights
    are averaged by how much each shard has learnt about a bucket. What reaches the driver is one
    model. Without rows the weights are zero.
    """
    known = marks.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    known = known.where((F.col("grade") >= 0) & (F.col("grade") < grades) & F.col("id").isNotNull())
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    place = F.xxhash64("id", "grade", F.lit("rating sample"))
    few = known.where(F.pmod(place, F.lit(1 << 20)) / float(1 << 20) < min(1.0, max_rows / max(1, total)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(few), "id")
    shards = max(1, round(min(total, max_rows) / shard_rows))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(buckets)
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                    pa.array([m[1] for m in made], pa.list_(pa.float64())),
                ],
                names=["place", "grade", "buckets", "vals"],
            )

    rows = chosen.select(place.alias("place"), "grade", "text").mapInArrow(
        featurize, "place bigint, grade int, buckets array<int>, vals array<double>"
    )
    once = rows.groupBy("place").agg(F.min(F.struct("grade", "buckets", "vals")).alias("r")).select("place", "r.*")
    rows = materialize(once, "rated").withColumn("shard", F.pmod(F.shiftright("place", 21), F.lit(shards)).cast("int"))
    held = rows.select("grade", F.explode("buckets").alias("bucket")).groupBy("grade", "bucket").count().toArrow()
    table = np.zeros((grades, buckets))
    table[held["grade"].to_numpy(), held["bucket"].to_numpy()] = held["count"].to_numpy()
    sampled = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    used = informative(table, np.array([sampled.get(g, 0) for g in range(grades)], float), min_rows, min_z)
    share = np.array([counts.get(g, 0) + 1 for g in range(grades)], float)
    odds = np.cumsum(share)[:-1] / share.sum()
    model = OrdinalModel(np.zeros(buckets), np.log(odds / (1 - odds)))
    for k in range(rounds if total else 0):
        fitted = rows.groupBy("shard").applyInPandas(_fitter(model, used, epochs, rate / (k + 1), k), "bucket bigint, learnt double, value double")
        mean = (F.sum(F.col("learnt") * F.col("value")) / F.sum("learnt")).alias("value")
        merged = fitted.groupBy("bucket").agg(mean).toArrow()
        place_of, value = merged["bucket"].to_numpy(), merged["value"].to_numpy()
        weights, cuts = model.weights.copy(), model.cuts.copy()
        weights[place_of[place_of >= 0]] = value[place_of >= 0]
        cuts[-1 - place_of[place_of < 0]] = value[place_of < 0]
        model = OrdinalModel(weights, np.maximum.accumulate(cuts))
    return model


def rate(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5
) -> DataFrame:
    """``(id_col, expected_grade, tail, kept)`` for every row, from its whole text.

    ``expected_grade`` is the mean of the grade's distribution, ``tail`` the probability of the best
    grade, ``kept`` whether that is at least ``keep_at``. The model is broadcast (``buckets``
    floats). A null text counts as empty; its grade follows from the signs of an empty text. Repeated rows are
    rated each, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.cuts))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        features = Featurizer(len(known.weights))
        for batch in batches:
            scores = np.zeros(len(batch))
            for i, text in enumerate(batch.column(1)):
                index, value = features(text.as_py())
                scores[i] = known.weights[index] @ value
            above = known.above(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, -1])], names=["id", "expected_grade", "tail"]
            )

    rated = rows.mapInArrow(run, f"id {kind}, expected_grade double, tail double")
    return rated.select(F.col("id").alias(id_col), "expected_grade", "tail", (F.col("tail") >= keep_at).alias("kept"))


def grade(quality: Column, toxic: Column) -> Column:
    """Three grades of two marks: 2 good and not toxic, 1 one fault, 0 both faults; null if a mark is."""
    return quality.cast("int") + 1 - toxic.cast("int")
