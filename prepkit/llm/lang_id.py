"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import col

UNKNOWN = "und"
_PIECE = 1 << 20  # code points scored at once, so that a very long text needs no more memory
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str, orders: int, buckets: int) -> Iterator[np.ndarray]:
    """Hashed n-grams (1 to ``orders`` code points) of the lower-cased text, piece by piece.

    Runs of anything but letters count as one boundary sign, and the text begins and ends with
    one. The cut into pieces does not show in the result. A text without letters yields nothing.
    """
    carried = np.zeros(1, np.uint64)
    for at in range(0, len(text), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.where(letters()[points], points, 0).astype(np.uint64)
        last = np.zeros(int(at + _PIECE >= len(text)), np.uint64)
        line = np.concatenate([carried, points, last])
        line = line[np.append(True, (line[1:] != 0) | (line[:-1] != 0))]
        mixed, found = np.zeros(len(line), np.uint64), []
        for n in range(1, orders + 1):
            ends = line[n - 1 :]
            mixed = mixed[: len(ends)] * np.uint64(0x9E3779B97F4A7C15) + ends + np.uint64(n)
            own = mixed[max(0, len(carried) - n + 1) :]  # the others ended in what was carried
            found.append(own[line[len(carried) :] != 0] if n == 1 else own)
        codes = np.concatenate(found)
        if len(codes):
            codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield ((codes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        carried = line[len(line) - min(len(line), max(1, orders - 1)) :]


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities, one row per hash bucket and one column per language."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    orders: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability; ``und`` and 0 without letters."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        total, seen = self.prior.copy(), False
        for part in grams(text, self.orders, len(self.weights)):
            total += self.weights.take(part, axis=0).sum(axis=0, dtype=np.float64)
            seen = True
        if not seen:
            return UNKNOWN, 0.0
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def train(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    orders: int = 3,
    buckets: int = 1 << 16,
    max_rows_per_lang: int = 4000,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Fit the model on labelled rows: at most about ``max_rows_per_lang`` of each language.

    The bound is a parameter of the fit; rows are chosen by a hash of the id, the same at any
    partitioning. Rows without a label are left out; without any labelled row the model knows no
    language and answers ``und``. N-gram counts are added up per task, so a task sends one row of
    ``buckets`` counts per language it has seen.
    """
    rows = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    ).where("lang IS NOT NULL")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(totals))
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_rows_per_lang / n))).otherwise(share)
    place = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where((place < share) & F.col("text").isNotNull()).select("lang", "text")
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = counts.setdefault(lang.as_py(), np.zeros(buckets, np.int64))
                for part in grams(text.as_py(), orders, buckets):
                    own += np.bincount(part, minlength=buckets)
        for lang, own in counts.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * buckets),
                    "bucket": pa.array(np.arange(buckets, dtype=np.int32)),
                    "n": pa.array(own),
                }
            ).filter(pa.array(own > 0))

    counted = chosen.mapInArrow(count, "lang string, bucket int, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets, len(langs)))
    columns = np.fromiter((number[x] for x in table["lang"].to_pylist()), np.int64, len(table))
    counts[table["bucket"].to_numpy(), columns] = table["n"].to_numpy()
    weights = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=0, keepdims=True))
    prior = np.log(np.array([totals[x] for x in langs], float) / max(1, sum(totals.values())))
    return LanguageModel(langs, weights.astype(np.float32), prior, orders)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None
) -> DataFrame:
    """``(id_col, *extra, lang_pred, score)`` for every row, from its whole text alone.

    The model (``buckets`` x languages floats) is broadcast and batches are scored by numpy. A
    null text or one without letters is ``und`` with score 0; a tie goes to the language that
    sorts first. ``extra`` are columns computed from the row and handed on.
    """
    extra = extra or {}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(text_col).alias("_text"), F.col(id_col).alias(id_col), *[c.alias(k) for k, c in extra.items()]
    )
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            best = [known.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())],
                names=[f.name for f in kept] + ["lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3: rows never learnt from (null ids: learnt from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(
    docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows, in their own columns, whose language is known with at least ``min_score``.

    Only the text goes to Python, and one boolean a row comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        best = [shared.value.predict(t.as_py()) for t in texts]
        return pa.array([lang != UNKNOWN and score >= min_score for lang, score in best], pa.bool_())

    return docs.where(known(col(text_col)))
