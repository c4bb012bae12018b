import random
import re

from pyspark.sql import functions as F

from prepkit.llm import decontamination
from tests.llm.conftest import ODD


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, width=5):
    w = words(text)
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


def slow(docs, items, threshold=0.8):
    found = {}
    for d, text in docs:
        own = {n: shingles(text, n) for n in range(1, 6)}
        for i, item in items:
            width = min(5, len(words(item)))
            wanted, own_ = (shingles(item, width), own[width]) if width else (set(), set())
            if wanted and len(wanted & own_) * 10 >= len(wanted) * round(threshold * 10):
                found[d, i] = (len(wanted), len(wanted & own_))
    return found


def as_dict(frame):
    return {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in frame.collect()}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_partial_passages_of_every_size(spark, docs):
    """Items of 5 to 200 words, from whole to half contained, in short and long documents: none is missed."""
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(rng.randint(5, 200)))) for i in range(60)]
    rows = []
    for d in range(240):
        words = items[d % 60][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = "changed"
        cut = rng.randint(len(words) * 6 // 10, len(words))
        filler = [f"f{rng.randrange(500)}" for _ in range(rng.choice([0, 5, 3000]))]
        rows.append((d, " ".join(filler + words[:cut] + filler).upper()))
    for threshold in (0.8, 1.0, 0.5):
        got = as_dict(decontamination.contained_items(docs(rows), bench(spark, items), threshold=threshold))
        assert got == slow(rows, items, threshold)


def test_items_of_a_few_words(spark, docs):
    """Items of 1 to 4 words are found where their words stand in a row, and nowhere else."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(5)}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    items = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(i % 6 + 1))) for i in range(24)]
    got = as_dict(decontamination.contained_items(docs(rows), bench(spark, items)))
    want = slow(rows, items)
    assert got == want
    assert {min(5, len(words(t))) for i, t in items if any(i == item for _, item in want)} >= {1, 2, 3}


def test_shuffled_lookups_give_the_same(spark, docs, monkeypatch):
    items = [(i, " ".join(f"{chr(97 + i)}{k}" for k in range(12))) for i in range(5)]
    rows = [(d, f"x {items[d % 5][1]} y") for d in range(30)]
    want = as_dict(decontamination.contained_items(docs(rows), bench(spark, items)))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert as_dict(decontamination.contained_items(docs(rows), bench(spark, items))) == want == slow(rows, items)


def test_odd_rows_and_items(spark, docs):
    items = [(1, None), (2, ""), (3, "one two three four"), (4, "same words again and again"), (4, "tie tie tie tie tie"), (None, "a row without an id")]
    items += [(4, "same words again and again")]
    frame = docs(ODD).withColumn("version", F.lit(1)).withColumn("item_id", F.lit(2))
    found = decontamination.contained_items(frame, bench(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["doc_id"]) == [(6, 4)]
    assert [(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is None] == [(None, None)]
    kept = decontamination.drop_contaminated(frame, bench(spark, items))
    assert kept.columns == frame.columns and kept.count() == len(ODD) - 2
    assert {r["text"] for r in kept.where("doc_id IS NULL").collect()} == {None}
    assert decontamination.contained_items(frame.where("false"), bench(spark, items)).count() == 0
    assert decontamination.contained_items(frame, bench(spark, items).where("false")).count() == 0


def test_no_python_on_the_path(docs, spark):
    plan = decontamination.contained_items(docs(ODD), bench(spark, [(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
