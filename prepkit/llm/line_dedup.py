"""Lines that many documents share, dropped from all but one; answers are compressed bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.sources.scratch import materialize

_BATCH = 4096  # rows handed on at once
_SPACE = b" \t\n\x0b\x0c\r"
_VERSION_SEED = 42  # of Spark's xxhash64, which gives the seed itself for null


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """The positions of each long line of a UTF-8 text by the 16-byte digest of its key.

    A key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of
    fewer than ``min_chars`` code points are left out.
    """
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_SPACE).lower()
        if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
    return found


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(key, doc, version, lines, n_lines)``: a row per document and key, and one without a key per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                some = batch.slice(at, _BATCH)
                key, row, version, lines, n_lines = [], [], [], [], []
                for i, value in enumerate(some.column(1)):
                    text = value.as_py()
                    mark = _VERSION_SEED if text is None else xxhash.xxh64_intdigest(text, _VERSION_SEED)
                    mark -= (mark >> 63) << 64
                    found = line_keys(text or b"", min_chars)
                    key += [None, *found]
                    lines += [None, *found.values()]
                    row += [i] * (1 + len(found))
                    version += [mark] * (1 + len(found))
                    n_lines += [(text or b"").count(b"\n") + 1] + [None] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.binary()),
                        some.column(0).take(pa.array(row, pa.int64())),
                        pa.array(version, pa.int64()),
                        pa.array(lines, pa.list_(pa.int32())),
                        pa.array(n_lines, pa.int64()),
                    ],
                    names=["key", "doc", "version", "lines", "n_lines"],
                )

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"key binary, doc {kind}, version bigint, lines array<int>, n_lines bigint")


def _stream(min_docs: int):
    """Walk one sorted partition; see ``shared_lines`` for the rows it yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = keeper = doc = None
        docs, first, waiting = 0, False, []
        n_runs = 0

        def close(last: bool) -> None:
            if first or last:
                out.append(("run", key, keeper, None, None, docs))
            if waiting and (first or last):
                out.extend(("open", key, d, v, lines, None) for d, v, lines in waiting)

        for batch in batches:
            for k, d, v, lines in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if k != key:
                    if key is not None:
                        close(False)
                    key, keeper, doc, docs, waiting = k, d, d, 1, []
                    first = n_runs == 0
                    n_runs += 1
                elif d != doc:
                    doc, docs = d, docs + 1
                if first:
                    out.append(("open", k, d, v, lines, None))
                elif d != keeper:
                    if docs < min_docs:
                        waiting.append((d, v, lines))
                    else:
                        out.extend(("drop", None, *held, None) for held in waiting)
                        out.append(("drop", None, d, v, lines, None))
                        waiting = []
                if len(out) >= _BATCH:
                    yield pack(out, batch.schema)
                    out = []
            names = batch.schema
        if key is not None:
            close(True)
        if out:
            yield pack(out, names)

    def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [pa.string(), pa.binary(), schema.field(1).type, pa.int64(), pa.list_(pa.int32()), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names=["what", "key", "doc", "version", "lines", "n_docs"])

    return run


def shared_lines(found: DataFrame, min_docs: int) -> DataFrame:
    """``(doc, version, lines)``: the line positions that go, from rows of ``occurrences`` with a key.

    Rows are range-partitioned by key and document, so that even one key's rows spread over
    partitions, and sorted by key, then document from the largest down: the first document of a
    key's run is the one that keeps the line, and from the ``min_docs``-th on all others lose it.
    A task holds back only the rows of the first few documents of the current run. Runs cut by a
    partition's border are settled afterwards: each partition reports the sizes and first documents
    of its first and last run (two rows, which bounds the broadcast), and the rows still open
    meet their key's total.
    """
    dealt = found.repartitionByRange("key", F.col("doc").desc_nulls_last()).sortWithinPartitions(
        "key", F.col("doc").desc_nulls_last(), "version"
    )
    kind = found.schema["doc"].dataType.simpleString()
    schema = f"what string, key binary, doc {kind}, version bigint, lines array<int>, n_docs bigint"
    walked = materialize(dealt.select("key", "doc", "version", "lines").mapInArrow(_stream(min_docs), schema), "lines")
    runs = (
        walked.where("what = 'run'")
        .groupBy("key")
        .agg(F.sum("n_docs").alias("total"), F.max("doc").alias("keeper"))
        .where(F.col("total") >= min_docs)
        .select("key", "keeper")
    )
    late = walked.where("what = 'open'").join(F.broadcast(runs), "key").where("NOT (doc <=> keeper)")
    return walked.where("what = 'drop'").select("doc", "version", "lines").unionByName(
        late.select("doc", "version", "lines")
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``(id_col, version, n_lines, n_dropped, keep)``: which lines of each document stay.

    ``keep`` is a zlib-compressed bitmap, first line in the highest bit of the first byte; null
    where every line stays. Lines are parts of the whole text between ``\\n``; null and empty texts are one
    empty line. Lines of equal key (see ``line_keys``) with at least ``min_chars`` code points,
    found in at least ``min_docs`` documents, stay in the largest id only, all of them there.
    ``version`` is Spark's xxhash64 of the text: rows of the same id count as one document
    and have a bitmap per text, equal rows one bitmap. A null id is one document, smaller than
    all. An empty table gives no rows.
    """
    found = materialize(occurrences(docs, id_col, text_col, min_chars), "occurrences")
    lost = shared_lines(found.where("key IS NOT NULL"), min_docs)
    lost = lost.groupBy("doc", "version").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    sizes = found.where("key IS NULL").select("doc", "version", "n_lines").distinct()
    same = F.col("s.doc").eqNullSafe(F.col("l.doc")) & (F.col("s.version") == F.col("l.version"))
    both = sizes.alias("s").join(lost.alias("l"), same, "left").select("s.*", "l.lines")

    @F.pandas_udf(T.BinaryType())
    def bitmap(n_lines: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([_bitmap(n, gone) for n, gone in zip(n_lines, lines)], dtype=object)

    return both.select(
        F.col("doc").alias(id_col),
        "version",
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_dropped"),
        bitmap("n_lines", "lines").alias("keep"),
    )


def _bitmap(n_lines: int, gone: np.ndarray | None) -> bytes | None:
    if gone is None:
        return None
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(gone, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept_text(text: str | None, keep: bytes | None) -> str | None:
    """The lines of a text that its bitmap keeps."""
    if text is None or keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([lines[i] for i in np.flatnonzero(bits).tolist()])


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([kept_text(t, k) for t, k in zip(text, keep)], dtype=object)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows joined with their bitmaps, as ``struct`` columns ``row`` and ``bits``."""
    left = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("_version"))
    right = bitmaps.select(F.struct("*").alias("bits"))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col(f"bits.{id_col}")) & (F.col("_version") == F.col("bits.version"))
    return left.join(right, same, "left").drop("_version")


def kept(row_text: Column, keep: Column) -> Column:
    """The text that a bitmap leaves; only texts that lose lines pass through Python."""
    return F.coalesce(_kept(F.when(keep.isNotNull(), row_text), keep), row_text)


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """The rows, in their own columns, with shared lines taken out of the text.

    Bitmaps are written first and not filtered by their own value, which would be computed once more for it: so no
    task runs two Python workers.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).where("n_dropped > 0")
    bitmaps = materialize(bitmaps.select(id_col, "version", "keep"), "bitmaps")
    joined = with_bitmaps(docs, bitmaps, id_col, text_col)
    columns = [
        kept(F.col("row")[c], F.col("bits.keep")).alias(c) if c == text_col else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return joined.select(*columns)
