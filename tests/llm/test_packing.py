import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prepkit.llm import packing
from prepkit.llm.queries import RANK_FILE
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokens():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids


AWKWARD = [
    "",
    " ",
    "  two  spaces ",
    "line\n\n next",
    "line \nnext",
    "tab\t x",
    "it's they've 'tis I'll",
    "a b  c 　d",
    "<|endoftext|> inside",
    "12 345, 6.7!? ***",
    "漢字かな 🙂🙂 é́",
    "trailing\n",
    "\x1c x \x85 y",
]


def test_ids_are_those_of_the_tokenizer(tokens, corpus):
    texts = AWKWARD + [t for _, t in corpus]
    coder = packing.CachedTokenizer(RANK_FILE)
    for got, text in zip(coder.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == tokens(text), text[:80]
    rng = random.Random(5)
    mixed = ["".join(rng.choices(["a", "b1", " ", "  ", "\n", "'s", ".", "é", " "], k=30)) for _ in range(500)]
    for got, text in zip(coder.encode(mixed), mixed):
        assert np.frombuffer(got, "<u4").tolist() == tokens(text), repr(text)


def test_forgetting_words_changes_nothing(tokens, corpus, monkeypatch):
    monkeypatch.setattr(packing, "_GENERATION", 10)
    coder = packing.CachedTokenizer(RANK_FILE)
    for _, text in corpus[:40]:
        (got,) = coder.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == tokens(text)


def test_fewer_remembered_words_change_nothing(docs, corpus):
    made = [packing.token_pieces(docs(corpus), RANK_FILE, remembered=n) for n in (None, 10)]
    first, second = (sorted(map(tuple, m.collect())) for m in made)
    assert first == second
    coder = packing.CachedTokenizer(RANK_FILE, 10)
    for _, text in corpus[:40]:
        list(coder.encode([text]))
    most = max(len(set((t or "").split(" "))) for _, t in corpus[:40])
    assert len(coder._old) + len(coder._new) <= 2 * (10 + most)


def check_packed(rows, texts, tokens):
    """Exact round trip: pieces make up each document, sequences are gapless and full enough."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids, at = tokens(text) + [2], 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            own = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            assert r["length"] == 1024 if k else 0 < r["length"] <= 1024
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence)


def test_corpus(docs, corpus, tokens):
    rows = packing.pack_documents(docs(corpus), RANK_FILE).collect()
    sequences = check_packed(rows, dict(corpus), tokens)
    assert sequences <= sum(r["length"] for r in rows) / 1024 * 1.03 + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_holds_every_constraint(score):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 3000)
    limits = packing.Capacity(1024, 3, 700_000 + 1024**2 // 2)
    bins, offsets = packing.best_fit(lengths, limits, score)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1024 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= limits.attention + 1e-3
        order = np.argsort(offsets[bins == b])
        assert (np.sort(offsets[bins == b]) == np.concatenate([[0], np.cumsum(own[order])[:-1]])).all()


def test_attention_capacity_binds():
    lengths = np.array([10, 10, 10, 10])
    assert len(set(packing.best_fit(lengths, packing.Capacity(100, 10, 200))[0])) == 2
    assert len(set(packing.best_fit(lengths, packing.Capacity(100, 10, 400))[0])) == 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([50]), packing.Capacity(40, 1, 10_000))
    assert len(packing.best_fit(np.array([], int), packing.Capacity())[0]) == 0


def test_groups_leave_few_part_filled_sequences(spark):
    pieces = spark.range(4000).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 500 + 512).alias("length"))
    rows = packing.pack(pieces, group_rows=500).collect()
    assert len(rows) == 4000
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024


def test_odd_rows(docs, tokens):
    rows = packing.pack_documents(docs(ODD).withColumn("piece", F.lit(1)), RANK_FILE).collect()
    for i, t in ODD:
        if i not in (None, 7):
            assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(tokens(t)) + 1
    assert len([r for r in rows if r["doc_id"] == 7]) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 1 + len(tokens("a row without an id")) + 1
    assert packing.pack_documents(docs(ODD).where("false"), RANK_FILE).count() == 0
