"""Divergence of sources: how each source's term frequencies differ from its language and from other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import col
from prepkit.operators.aggregates import lookup_join, settle
from prepkit.sources.scratch import materialize

SEED = 42
HELD = 500_000  # counters that a task holds before it sends them on
SLICE = 16_384  # rows of an Arrow batch
BROADCAST_TERMS = 4_000_000  # most digests of kept terms that are broadcast, 8 bytes each
TILE = 128  # sources on one side of a block of pairs
CELLS = 400_000  # about as many counters has a block of pairs, in (sources, terms)

# A term is a run of ASCII letters and of characters beyond ASCII, A-Z lower-cased.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included."""
    return text.translate(_TERM_BYTES).split()


def _group(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(*_group(docs, lang_col, source_col), text)


def _digests(terms: list[bytes], bits: int) -> np.ndarray:
    digests = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))
    return (digests >> np.uint64(64 - bits)).view(np.int64)


def document_counts(rows: DataFrame, bits: int) -> DataFrame:
    """``(lang, digest, docs)``: documents by term digest, as each task pre-aggregates them."""

    def table(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            digests, docs = _digests(list(found), bits), np.fromiter(found.values(), np.int64, len(found))
            for at in range(0, len(docs), SLICE):
                some = [pa.array(x[at : at + SLICE]) for x in (digests, docs)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some[0])), *some], names=["lang", "digest", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(2)):
                held.setdefault(lang.as_py(), Counter()).update(set(terms_of(text.as_py())))
                if sum(map(len, held.values())) > HELD:
                    yield from table(held)
                    held = {}
        yield from table(held)

    return rows.mapInArrow(run, "lang string, digest bigint, docs bigint")


def term_counts(rows: DataFrame, bits: int, kept: DataFrame, exact: bool = False) -> DataFrame:
    """``(lang, source, digest, term, n, docs)`` of the kept digests, as each task pre-aggregates them.

    Up to ``BROADCAST_TERMS`` the kept digests are broadcast and others never leave the task that
    counts them; beyond that the rows of others are written too, and dropped by the joins that follow.
    A term's string stands in the first of its rows that a task writes for its language, and ``docs`` is
    null; with ``exact`` both stand in all of them.
    """
    known = None
    if kept.count() <= BROADCAST_TERMS:
        found = kept.select("digest").toArrow().column("digest").to_numpy()
        known = rows.sparkSession.sparkContext.broadcast(np.unique(found))

    def table(held: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        told: dict[str, set] = {}
        for (lang, source), times in held.items():
            terms = list(times)
            digests, n = _digests(terms, bits), np.fromiter(times.values(), np.int64, len(terms))
            if known is not None:
                order = np.argsort(digests)  # a search in order takes a fraction of the time
                at = np.searchsorted(known.value, digests[order])
                mine = at < len(known.value)
                mine[mine] = known.value[at[mine]] == digests[order[mine]]
                order = order[mine]
                terms, digests, n = [terms[i] for i in order.tolist()], digests[order], n[order]
            before = told.setdefault(lang, set())
            for at in range(0, len(terms), SLICE):
                some = terms[at : at + SLICE]
                names = some if exact else [None if t in before else t for t in some]
                found = pa.array([docs[lang, source][t] for t in some], pa.int64()) if exact else pa.nulls(len(some), pa.int64())
                columns = [
                    pa.repeat(lang, len(some)),
                    pa.repeat(source, len(some)),
                    pa.array(digests[at : at + SLICE]),
                    pa.array(names, pa.binary()).cast(pa.string()),
                    pa.array(n[at : at + SLICE]),
                    found,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "term", "n", "docs"])
            before.update(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                group = lang.as_py(), source.as_py()
                terms, times = terms_of(text.as_py()), held.setdefault(group, Counter())
                size -= len(times)
                times.update(terms)
                size += len(times)
                if exact:
                    docs.setdefault(group, Counter()).update(set(terms))
                if size > HELD:
                    yield from table(held, docs)
                    held, docs, size = {}, {}, 0
        yield from table(held, docs)

    return rows.mapInArrow(run, "lang string, source string, digest bigint, term string, n bigint, docs bigint")


def kept_terms(rows: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Terms in at least ``min_docs`` documents of their language, and their counts by source.

    ``(lang, digest, place, term, total)`` and ``(lang, source, digest, place, n, total)``, both written.
    Only digests are grouped. A digest below ``min_docs`` documents holds no kept term, whatever
    shares it; of the others, the number of different strings tells whether different terms
    meet in it. Those few are counted anew by their strings and numbered by ``place``.
    """
    keys = ["lang", "digest"]
    documents = document_counts(rows, bits).groupBy(*keys).agg(F.sum("docs").alias("docs"))
    kept = materialize(documents.where(F.col("docs") >= min_docs).select(*keys), "kept_digests")
    counts = materialize(term_counts(rows, bits, kept), "term_counts")
    by_source = counts.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"))
    by_source = materialize(by_source, "source_terms")
    totals = by_source.groupBy(*keys).agg(F.sum("n").alias("total"))
    # different strings are hashed first, as the smallest string alone would sort the rows of all tasks
    named = counts.where("term is not null").select(*keys, "term").distinct()
    named = named.groupBy(*keys).agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("strings"))
    # digests are broadcast without their language, so one may be kept in another language only
    strings = materialize(named.join(kept, keys).join(totals, keys), "term_strings")
    terms = strings.where("strings = 1").select(*keys, F.lit(0).alias("place"), "term", "total")
    by_term = by_source.select("lang", "source", "digest", "n", F.lit(0).alias("place"))
    mixed = strings.where("strings > 1").select(*keys)
    if mixed.take(1):
        exact = term_counts(rows, bits, mixed, exact=True).join(mixed, keys, "left_semi")
        exact = exact.groupBy("lang", "source", "digest", "term")
        exact = materialize(exact.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split_terms")
        whole = exact.groupBy(*keys, "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        order = Window.partitionBy(*keys).orderBy("term")
        split = whole.where(F.col("docs") >= min_docs).select(*keys, F.row_number().over(order).alias("place"), "term", "total")
        split = materialize(split, "split_places")
        terms = terms.unionByName(split)
        again = exact.drop("docs").join(split.select(*keys, "term", "place"), [*keys, "term"]).drop("term")
        by_term = by_term.unionByName(again)
    terms = materialize(terms, "terms")
    return terms, materialize(by_term.join(terms.drop("term"), [*keys, "place"]), "term_table")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of a number and a positive one, exact also beyond 64 bits."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def _probability(n: Column, whole: Column, terms: Column) -> Column:
    below = F.greatest(whole + terms, F.lit(1))
    large = _div((n + 1).cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)"), below)
    small = F.call_function("div", (n + 1) * F.lit(10**9).cast("bigint"), below)
    return 1 + F.when(n < 9 * 10**9, small).otherwise(large)  # 64 bits hold the product of a small count


def _gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)  # p and q are at most 10^9 + 1: 64 bits hold the square


def group_sizes(docs: DataFrame, table: DataFrame, terms: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, source, n_terms, n_group, n_lang, n_sources, cells)`` of every (language, source) that occurs."""
    groups = docs.select(*_group(docs, lang_col, source_col)).distinct()
    of_group = table.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("held"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang"))
    sized = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    sources = sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("held").alias("cells"))
    return materialize(sized.drop("held").join(sources, "lang"), "groups")


def _with_sizes(table: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    key = F.struct("lang", "source")
    some, small = settle(groups.select(key.alias("of_group"), *columns))
    return lookup_join(table, some, small, key, "of_group").drop("of_group")


def top_terms(table: DataFrame, terms: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value, rank)``: the ``top`` terms that a source has more often than its language.

    Ranking by value alone finds the candidates, ties at the border included; only these get their strings.
    """
    sized = _with_sizes(table, groups, ["n_terms", "n_group", "n_lang"])
    p = _probability(F.col("n"), F.col("n_group"), F.col("n_terms"))
    q = _probability(F.col("total"), F.col("n_lang"), F.col("n_terms"))
    rows = sized.select("lang", "source", "digest", "place", p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "digest", "place", _gain(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("lang", "source")
    first = rows.withColumn("place_by_value", F.rank().over(group.orderBy(F.desc("value"))))
    first = materialize(first.where(F.col("place_by_value") <= top).drop("place_by_value"), "candidates")
    named = first.join(terms.select("lang", "digest", "place", F.col("term").alias("item")), ["lang", "digest", "place"])
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of one block, for all pairs between two tiles of sources.

    A term without occurrences in a source has the source's least probability ``base``. Summed is
    what a term adds to the value of a pair without any occurrence, which is the same for all terms.
    """
    heads = rows[rows["held"] == 0]
    left, right = (heads[heads["side"] == side].sort_values("source") for side in (0, 1))
    cells = rows[rows["held"] == 1]
    terms, at = np.unique(cells[["digest", "place"]].to_numpy(np.int64), axis=0, return_inverse=True)
    at = at.ravel()

    def dense(tile: pd.DataFrame, side: int) -> tuple[np.ndarray, np.ndarray]:
        base = tile["p"].to_numpy(np.int64)
        out = np.repeat(base[:, None], len(terms), axis=1)
        mine = (cells["side"] == side).to_numpy()
        row = {s: i for i, s in enumerate(tile["source"])}
        out[cells["source"][mine].map(row).to_numpy(np.int64), at[mine]] = cells["p"][mine].to_numpy(np.int64)
        return base, out

    (lb, lp), (rb, rp) = dense(left, 0), dense(right, 1)
    out = []

    def sums(names: pd.Series, others: pd.Series, p: np.ndarray, pb: np.ndarray, q: np.ndarray, qb: np.ndarray) -> None:
        for name, mine, base in zip(names, p, pb):
            plain = (base - qb) ** 2 // qb
            more = ((mine[None, :] - q) ** 2 // q - plain[:, None]).sum(axis=1)
            out.append(pd.DataFrame({"source": name, "item": others.to_numpy(), "plain": plain, "more": more}))

    sums(left["source"], right["source"], lp, lb, rp, rb)
    if rows["ti"].iloc[0] != rows["tj"].iloc[0]:
        sums(right["source"], left["source"], rp, rb, lp, lb)
    found = pd.concat(out)
    found.insert(0, "lang", rows["lang"].iloc[0])
    return found[found["source"] != found["item"]]


def source_pairs(table: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: every source against every other one of its language.

    Counters are dealt into blocks of (tile of sources, tile of sources, part of the terms), so that a
    task holds at most about ``CELLS`` dense counters whatever a language's size, and returns one
    partial sum for each pair of its tiles; no pair is formed for a single term.
    """
    parts = F.ceil(
        F.greatest(F.col("n_terms") * F.least("n_sources", F.lit(2 * TILE)) / CELLS, F.col("cells") / (CELLS // 8), F.lit(1.0))
    ).cast("int")
    tiles = F.ceil(F.col("n_sources") / TILE).cast("int")
    least = _probability(F.lit(0), F.col("n_group"), F.col("n_terms"))
    dealt = groups.select(
        "lang", "source", "n_terms", "n_group", parts.alias("parts"), tiles.alias("tiles"), least.alias("least"),
        F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"),
    )
    dealt = materialize(dealt, "tiles")
    p = _probability(F.col("n"), F.col("n_group"), F.col("n_terms"))
    cells = _with_sizes(table, dealt, ["n_terms", "n_group", "parts", "tiles", "tile"])
    cells = cells.select(
        "lang", "source", "digest", "place", p.alias("p"), F.lit(1).alias("held"), "tile", "tiles",
        F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"),
    )
    heads = dealt.select(
        "lang", "source", F.lit(0).cast("bigint").alias("digest"), F.lit(0).alias("place"), F.col("least").alias("p"),
        F.lit(0).alias("held"), "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    other, tile = F.col("other"), F.col("tile")
    sides = F.when(other == tile, F.array(F.lit(0), F.lit(1))).otherwise(F.array((tile > other).cast("int")))
    blocks = (
        cells.unionByName(heads)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("side", F.explode(sides))
        .withColumns({"ti": F.least(tile, other), "tj": F.greatest(tile, other)})
        .select("lang", "source", "digest", "place", "p", "held", "side", "ti", "tj", "part")
    )
    sums = blocks.groupBy("lang", "ti", "tj", "part").applyInPandas(
        _pair_sums, "lang string, source string, item string, plain bigint, more bigint"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.max("plain").alias("plain"), F.sum("more").alias("more"))
    sized = _with_sizes(pairs, dealt, ["n_terms"])
    value = (F.col("plain") * F.col("n_terms") + F.col("more")).alias("value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sized.select("lang", "source", "item", value).withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 3,
    top: int = 200,
    bits: int = 64,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source's words are from others'.

    Terms of a language in at least ``min_docs`` of its rows count. With V of them and n occurrences of a
    term among the N of a source (or a language), p = 1 + floor(10^9 (n + 1) / (N + V)). Part ``pair``
    has for each other source of the language the sum over all terms of floor((p - q)^2 / q), part
    ``term`` the ``top`` terms of the source with p above the language's q. All numbers are exact.

    Null texts, languages and sources are empty strings; every (language, source) pair that occurs
    counts, also without any term; a source alone in its language has no pairs, an empty table gives
    no rows. A repeated row is a document of its own. Ties go to the smaller string (by UTF-8). Other
    columns are not read. Texts are counted where they are read; shuffled are ``bits``-bit digests.
    """
    terms, table = kept_terms(_rows(docs, text_col, lang_col, source_col), min_docs, bits)
    groups = group_sizes(docs, table, terms, lang_col, source_col)
    found = {"pair": source_pairs(table, groups), "term": top_terms(table, terms, groups, top)}
    frames = [f.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, f in found.items()]
    return frames[0].unionByName(frames[1])
