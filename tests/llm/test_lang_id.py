import math
import re
from collections import Counter
import zlib

import numpy as np
from pyspark.sql import functions as F

from prepkit.llm import lang_id
from tests.llm.conftest import ODD


def test_held_out_accuracy(table):
    docs = table("documents")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    found = lang_id.identify(docs, model, extra={"held_out": lang_id.held_out()})
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_is_the_checksum_of_the_id(spark):
    rows = spark.range(50).select("id", lang_id.held_out("id").alias("out")).collect()
    assert [r["out"] for r in rows] == [zlib.crc32(str(r["id"]).encode()) % 3 == 1 for r in rows]


def test_pieces_do_not_show(monkeypatch):
    text = "Ünter  den, Linden 99 -- und so weiter? İstanbul 漢字 " * 40
    for orders in (1, 2, 3, 5):
        whole = np.sort(np.concatenate(list(lang_id.grams(text, orders, 1 << 16))))
        for piece in (1, 2, 3, 7, 64):
            monkeypatch.setattr(lang_id, "_PIECE", piece)
            parts = np.sort(np.concatenate(list(lang_id.grams(text, orders, 1 << 16))))
            assert (whole == parts).all(), (orders, piece)
            monkeypatch.undo()


def test_number_of_grams():
    assert sum(map(len, lang_id.grams("ab", 3, 100))) == 2 + 3 + 2  # a b; ^a ab b$; ^ab ab$
    assert sum(map(len, lang_id.grams("a--b", 2, 100))) == 2 + 4
    assert list(lang_id.grams("12 --\n", 3, 100)) == [] and list(lang_id.grams("", 3, 100)) == []


def test_naive_bayes_by_hand(spark):
    rows = [(1, "aaaa", "x"), (2, "bbbb", "y"), (3, "bbbb", "y"), (4, "cc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang_id.train(docs, orders=1, buckets=64)
    assert model.langs == ("x", "y")
    assert model.predict("a")[0] == "x" and model.predict("b")[0] == "y"
    counts = np.array([4.5, 0.5]) / (4 + 32), np.array([0.5, 8.5]) / (8 + 32)
    want = counts[0][0] * (1 / 3) / (counts[0][0] * (1 / 3) + counts[1][0] * (2 / 3))
    assert abs(model.predict("a")[1] - want) < 1e-6


def test_odd_rows(docs):
    frame = docs(ODD).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(1))
    model = lang_id.train(docs([(1, "the quick brown fox"), (2, "and the lazy dog")]))
    found = lang_id.identify(frame, model).collect()
    assert len(found) == len(ODD)
    unknown = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert unknown == {1, 2, 3, 8, None}
    assert {r["score"] for r in found if r["lang_pred"] == "und"} == {0.0}
    kept = lang_id.keep_identified(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(ODD) - 5
    assert lang_id.identify(frame.where("false"), model).count() == 0
    none = lang_id.train(docs(ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in lang_id.identify(docs(ODD), none).collect()} == {"und"}


def test_fit_is_bounded_and_repeatable(docs):
    many = docs([(i, f"word{i} common") for i in range(400)], 7)
    model = lang_id.train(many, max_rows_per_lang=100)
    again = lang_id.train(many.repartition(2), max_rows_per_lang=100)
    assert (model.weights == again.weights).all()


def slow_grams(text, orders=3):
    """Runs of letters between single boundary signs, and all their n-grams, as strings."""
    line = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    if not line.strip():
        return Counter()
    return Counter(
        line[i : i + n] for n in range(1, orders + 1) for i in range(len(line) - n + 1) if n > 1 or line[i] != " "
    )


def test_grams_against_strings(corpus):
    """The same number of different n-grams, as often each, over the whole corpus."""
    for _, text in corpus:
        parts = list(lang_id.grams(text, 3, 1 << 31))
        hashed = Counter(np.concatenate(parts).tolist()) if parts else Counter()
        want = slow_grams(text)
        assert sorted(hashed.values()) == sorted(want.values())


def test_model_against_exact_grams(spark, table):
    """Held-out languages as naive Bayes over unhashed n-grams gives them."""
    rows = table("documents").select("doc_id", "text", "lang", lang_id.held_out().alias("out")).collect()
    counts, seen = {}, Counter()
    for r in rows:
        if not r["out"] and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(slow_grams(r["text"] or ""))
            seen[r["lang"]] += 1
    known = set().union(*counts.values())
    best = {}
    for r in rows:
        own = slow_grams(r["text"] or "")
        odds = {
            lang: math.log(seen[lang]) + sum(n * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(known))) for g, n in own.items())
            for lang, c in counts.items()
        }
        best[r["doc_id"]] = max(odds, key=odds.get) if own else "und"
    docs = table("documents")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs, model).collect()}
    assert sum(got[i] == best[i] for i in got) >= 0.99 * len(got)


def test_filter_sends_only_texts_to_python(table):
    docs = table("documents")
    kept = lang_id.keep_identified(docs, lang_id.train(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
