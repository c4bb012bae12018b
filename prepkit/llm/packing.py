"""Token sequences of documents packed into fixed-length bins by vector best fit."""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.sources.scratch import materialize

#: How the byte-level BPE files cut a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GENERATION = 250_000  # words remembered, twice, if nothing else is said
_BATCH_CHARS = 1 << 21
_OPEN_RUN = re.compile(r" (?:\s|$)")
_tokenizers: dict[tuple[str, int | None], "CachedTokenizer"] = {}


class CachedTokenizer:
    """Byte-level BPE of a public rank file, with the ids of recent words kept.

    Between two words that are parted by one space nothing merges, so a text is cut there and
    each piece is encoded once; a text in which a space is followed by more white space (or ends)
    is encoded as a whole. Strings of special tokens are ordinary text. Ids are little-endian
    unsigned 32-bit integers in bytes.
    """

    def __init__(self, rank_file: str, remembered: int | None = None):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._new, self._old = coder.encode_ordinary, {}, {}
        self._remembered = remembered

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if _OPEN_RUN.search(t) else t.split(" ") for t in texts]
        for words in cut:
            for word in {w for w in (words or ())[1:]}.difference(self._new):
                self._new[word] = self._old.get(word) or self.ids(" " + word)
        known = self._new
        for text, words in zip(texts, cut):
            yield self.ids(text) if words is None else self.ids(words[0]) + b"".join([known[w] for w in words[1:]])
        if len(known) > (self._remembered or _GENERATION):
            self._old, self._new = known, {}


def tokenizer(rank_file: str, remembered: int | None = None) -> CachedTokenizer:
    if (rank_file, remembered) not in _tokenizers:
        _tokenizers[rank_file, remembered] = CachedTokenizer(rank_file, remembered)
    return _tokenizers[rank_file, remembered]


def token_pieces(
    docs: DataFrame,
    rank_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 1024,
    remembered: int | None = None,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)``: each row's token ids and ``end_id``, cut to pieces.

    Only rows of more than ``capacity`` ids are cut, into pieces of ``capacity``; what is over is
    the first piece. ``ids_crc32`` is the checksum of the piece's ids as little-endian unsigned
    32-bit integers. A null text counts as empty: one piece that holds ``end_id`` alone. Lone
    surrogates cannot occur in Parquet strings. Repeated rows are cut each on their own. Workers keep the ids
    of about twice ``remembered`` words between their tasks (by default 250,000), which changes no result.
    """

    end = np.array([end_id], "<u4").tobytes()

    def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _BATCH_CHARS or i + 1 == len(texts):
                yield at, i + 1
                at, size = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(rank_file, remembered)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, piece, start, length, crc = [], [], [], [], []
            for a, b in portions(texts):
                for row, ids in enumerate(coder.encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row), piece.append(k), start.append(s), length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return made.withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Capacity:
    """What a bin can hold: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)


def best_fit(lengths: np.ndarray, capacity: Capacity, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, packed by vector best fit decreasing.

    Items come longest first. Of the open bins that can take an item under every constraint, the
    chosen one has the smallest norm of the residual left (``score="norm"``), or the greatest dot
    product of its residual and the item's demand (``score="dot"``), each dimension counted as a
    share of its capacity and weighted by the demand's mean share; a tie goes to the oldest bin;
    without a fitting bin one is opened. An item that fits no empty bin raises ``ValueError``.
    """
    n, full = len(lengths), capacity.vector()
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1) / full
    if n and demand.max() > 1:
        raise ValueError("an item is larger than an empty bin")
    weight = demand.mean(axis=0) if n else np.ones(3)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    room = np.empty((n, 3))  # residuals of the bins that can take the shortest item yet
    number, held, count, made = np.empty(n, np.int64), np.zeros(n, np.int64), 0, 0
    least = demand.min(axis=0) if n else 0
    for k, item in enumerate(order.tolist()):
        need = demand[item]
        open_ = room[:count]
        fits = np.flatnonzero((open_[:, 0] >= need[0] - 1e-12) & (open_[:, 1] >= need[1] - 1e-12) & (open_[:, 2] >= need[2] - 1e-12))
        if len(fits):
            left = open_[fits]
            if score == "norm":
                left = left - need
                at = fits[((left * left) @ weight).argmin()]
            else:
                at = fits[(left @ (weight * need)).argmax()]
        else:
            at, count = count, count + 1
            room[at], number[at], held[made], made = 1.0, made, 0, made + 1
        room[at] -= need
        bins[item], offsets[item] = number[at], held[number[at]]
        held[number[at]] += lengths[item]
        if k % 512 == 511:
            live = np.flatnonzero((room[:count] >= least - 1e-12).all(axis=1))
            room[: len(live)], number[: len(live)], count = room[live], number[live], len(live)
    return bins, offsets


def pack(
    pieces: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 16384, score: str = "norm"
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: which sequence each goes to, and where in it.

    Pieces are dealt by a hash of all their columns to as many groups as ``group_rows`` asks for
    and each group is packed by ``best_fit`` in one task, so a task holds a bounded number of rows
    whatever one document adds, and a group leaves at most a few sequences part-filled. Pieces of full
    length are a sequence of their own at once. Offsets in a sequence are gapless from 0. An empty
    table gives no rows. ``pieces`` must read the same each time (write it first).
    """
    groups, names = max(1, math.ceil(pieces.count() / group_rows)), list(pieces.columns)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("long"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), capacity, score)
        group = rows.pop("_group").to_numpy(np.int64)
        return rows.assign(sequence_id=(group << 32) + bins, offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    rank_file: str,
    capacity: Capacity = Capacity(),
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    score: str = "norm",
    remembered: int | None = None,
) -> DataFrame:
    """Tokenize whole texts, cut what is too long, and pack the pieces (see ``token_pieces``, ``pack``).

    Tokenizing happens once: its small piece table is written to the shared folder.
    """
    pieces = token_pieces(docs, rank_file, id_col, text_col, end_id, capacity.tokens, remembered)
    return pack(materialize(pieces, "pieces"), capacity, score=score)
