"""Product codes of vectors: codebooks per part, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import col
from prepkit.operators.aggregates import lookup_join, settle

MOST = float(2**60)  # scaled components are clamped to this magnitude
_HEX = np.array([f"{i:02x}" for i in range(256)], dtype="S2")
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by (part, entry, position); ``scale`` turned the vectors into integers."""

    entries: np.ndarray
    scale: int

    def width(self) -> int:
        """Components of the vectors that these codebooks are for."""
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; the lowest index on ties.

    By Cauchy and Schwarz (sum(x) - sum(y))^2 <= d |x - y|^2, so entries are sorted by their component
    sum and looked at outward from a row's own sum. A side ends where the squared gap of the sums
    strictly exceeds d times the best distance: no entry beyond it is nearer, or as near.
    """
    d, last = entries.shape[1], len(entries) - 1
    most = max(int(np.abs(a).max(initial=0)) for a in (parts, entries))
    if (2 * most * d) ** 2 >= 2**62:  # 64 bits do not hold the squares: Python's integers do
        parts, entries = parts.astype(object), entries.astype(object)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, own = sums[order], parts.sum(axis=1)
    start = np.searchsorted(sums, own)
    best = np.full(len(parts), -1, dtype=parts.dtype)
    index = np.zeros(len(parts), np.int64)
    sides = {1: np.arange(len(parts)), -1: np.arange(len(parts))}
    for step in range(last + 1):
        for way, rows in sides.items():
            at = start[rows] + (step if way > 0 else -1 - step)
            rows, at = rows[(at >= 0) & (at <= last)], at[(at >= 0) & (at <= last)]
            gap = own[rows] - sums[at]
            open_ = ((best[rows] < 0) | (gap * gap <= d * best[rows])).astype(bool)
            rows, entry = rows[open_], order[at[open_]]
            off = parts[rows] - entries[entry]
            far = (off * off).sum(axis=1)
            now = best[rows]
            better = ((now < 0) | (far < now) | ((far == now) & (entry < index[rows]))).astype(bool)
            best[rows[better]], index[rows[better]] = far[better], entry[better]
            sides[way] = rows
        if not any(map(len, sides.values())):
            break
    return index, best


def _integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(np.clip(flat * scale, -MOST, MOST)).astype(np.int64).reshape(-1, width)


def _assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, parts)`` arrays of entry indexes and squared distances."""
    cut = vectors.reshape(len(vectors), len(books), -1)
    found = [nearest(np.ascontiguousarray(cut[:, part]), books[part]) for part in range(len(books))]
    return np.stack([i for i, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def _kept(vectors: DataFrame, vector_col: str, width: int | None, parts: int) -> DataFrame:
    """Rows whose vector has only finite components and the right length, cast to doubles."""
    vector = col(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    size = F.size(vector)
    length = (size > 0) & (size % parts == 0) if width is None else size == width
    return vectors.where(F.coalesce(vector.isNotNull() & length & whole, F.lit(False)))


def train(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> Codebooks | None:
    """Codebooks of integer vectors floor(``scale`` x), after some rounds over all rows; None without any row.

    Rows count whose vector has a positive multiple of ``parts`` finite components, as many as the row
    with the smallest id has (null ids come last, equal ids follow the vectors). Entries begin as the
    parts of the ``entries`` smallest ids. A round assigns every part to its nearest entry and
    replaces an entry by the floor of its parts' mean, component by component; unused entries stay.
    A task sends one row of sums for each used entry and position, so what is shuffled and collected
    is bounded by the codebooks, however many equal vectors there are.
    """
    if entries > 256 or entries < 1:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    whole = _kept(vectors, vector_col, None, parts)
    vector = col(vector_col).cast("array<double>")
    order = [col(id_col).asc_nulls_last(), vector]
    first = whole.orderBy(*order).select(F.size(vector).alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    rows = whole.where(F.size(vector) == width)
    seeds = rows.orderBy(*order).limit(entries).select(vector.alias("v")).toArrow().column("v").combine_chunks()
    books = _integers(seeds, width, scale).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows.select(vector.alias("v")), books, scale)
    return Codebooks(books, scale)


def _moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts, sums = np.zeros(known.shape[:2], np.int64), np.zeros(known.shape, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _integers(batch.column(0), known.shape[0] * known.shape[2], scale)
            if len(vectors) * int(np.abs(vectors).max()) >= 2**62:
                vectors = vectors.astype(object)
            codes, _ = _assign(vectors, known)
            cut = vectors.reshape(len(vectors), known.shape[0], -1)
            for part in range(len(known)):
                total = np.zeros(known.shape[1:], vectors.dtype)
                np.add.at(total, codes[:, part], cut[:, part])
                sums[part] += total.astype(object)
                counts[part] += np.bincount(codes[:, part], minlength=known.shape[1])
        part, entry = counts.nonzero()
        at = np.tile(np.arange(known.shape[2]), len(part))
        columns = [np.repeat(x, known.shape[2]).astype(np.int32) for x in (part, entry)] + [at.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [
                *map(pa.array, columns),
                pa.array(np.repeat(counts[part, entry], known.shape[2])),
                pa.array([str(x) for x in sums[part, entry].ravel()], pa.string()),
            ],
            names=["part", "entry", "at", "n", "total"],
        )

    found = rows.mapInArrow(run, "part int, entry int, at int, n bigint, total string")
    summed = found.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    moved = books.copy()
    for r in summed.collect():  # a row per component of the codebooks
        moved[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return moved


def encode(
    vectors: DataFrame, books: Codebooks | None, vector_col: str = "embedding", keep: Sequence[str] = ("vec_id",)
) -> DataFrame:
    """``(*keep, code, error)`` of every row with a usable vector (see ``train``): two hex digits a part.

    ``error`` is the sum of the parts' squared distances to their entries (the largest 64-bit number, if
    it is beyond). Rows with a null, empty, shorter or longer vector, or with a component that
    is null or not finite, are left out; repeated rows are all kept. Without codebooks there are no rows.
    """
    parts = len(books.entries) if books else 1
    rows = _kept(vectors, vector_col, books.width() if books else -1, parts)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    plain = rows.select(col(vector_col).cast("array<double>"), *map(col, keep)).toDF("v", *[f"k{i}" for i in range(len(keep))])
    kinds = [f.dataType.simpleString() for f in plain.schema.fields[1:]]
    names = [*plain.columns[1:], "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = _assign(_integers(batch.column(0), known.width(), known.scale), known.entries)
            text = _HEX[codes].view(f"S{2 * codes.shape[1]}").ravel()
            error = errors.sum(axis=1) if errors.dtype != object else [min(int(e), _LONG) for e in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(text.astype(str)), pa.array(error, pa.int64())],
                names=names,
            )

    kept = "".join(f"{c} {kind}, " for c, kind in zip(plain.columns[1:], kinds))
    return plain.mapInArrow(run, f"{kept}code string, error bigint").toDF(*keep, "code", "error")


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """The rows with ``label_error``, the sum of ``error`` over all rows of equal label (nulls together).

    Sums are formed before the shuffle and joined back behind a size check, salted beyond it, so
    a label that holds most rows is no hot task. ``coded`` is read twice: pass a written table.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("bigint")
    sums = coded.groupBy(col(label_col).alias("of_label")).agg(total.alias("label_error"))
    sums, small = settle(sums)
    return lookup_join(coded, sums, small, col(label_col), "of_label", null_safe=True).drop("of_label")
