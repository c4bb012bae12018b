import random
import re

from pyspark.sql import functions as F

from prepkit.llm import license_scan
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(text):
    """Number of words and the places of every base phrase."""
    w = tokens(text)
    places = sorted((k, label) for p, label in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), places


def found(frame):
    rows = license_scan.scan(frame).collect()
    return [
        (r["doc_id"], r["n_words"], sorted((s, m["label"]) for m in r["matches"] if m["exact"] for s in m["starts"]), r)
        for r in rows
    ]


def test_base_phrases_of_the_corpus(docs, corpus):
    texts = dict(corpus)
    for doc, n, places, _ in found(docs(corpus)):
        assert (n, places) == slow(texts[doc])


def test_base_phrases_in_random_word_soup(docs):
    rng = random.Random(7)
    pool = [*"GNU General PUBLIC license apache License cc by mit Éé K other 2".split()]
    rows = [(i, "".join(w + rng.choice([" ", "-", "\n", " / "]) for w in rng.choices(pool, k=rng.randint(0, 300)))) for i in range(120)]
    rows.append((500, "license " * 30_000 + "mit license"))
    texts = dict(rows)
    got = found(docs(rows))
    assert sum(len(p) for _, _, p, _ in got) > 100
    for doc, n, places, _ in got:
        assert (n, places) == slow(texts[doc])


def notice(label):
    return next(t for t in license_scan.NOTICES if t.label == label)


def test_notices_with_other_words_between(docs):
    mit = notice("mit-text").text
    rows = {
        1: f"(c) me\n{mit.title()}.",
        2: mit.replace("free of charge", "free with charge"),  # not a mandatory phrase
        3: mit.replace("hereby granted", "hereby denied"),  # a mandatory phrase broken
        4: " ".join(random.Random(1).sample(mit.split(), len(mit.split()))),  # all words, elsewhere
        5: "Licensed under the Apache License, Version 2.0.",
        6: "plain text",
    }
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs(rows)).select(
        "doc_id", license_scan.labels(F.col("matches")).alias("labels"), "score").collect()}
    assert got[1] == ("mit-text", 1.0) and got[2][0] == "mit-text" and 0.5 < got[2][1] < 1
    assert got[3] == got[4] == got[6] == ("", 0.0)
    assert got[5] == ("apache,apache-2.0", 1.0)


def test_rarest_words_are_chosen_by_idf(docs):
    idf = license_scan.rarity(docs({1: "the mit", 2: "the License", 3: "the", 4: None}), "text", ["the", "mit", "zlib"])
    assert idf["the"] < idf["mit"] < idf["zlib"]
    (entry,) = license_scan.build_index([license_scan.Template("x", "the mit the zlib", exact=True)], idf)
    assert entry.rare == ((3, "zlib"),) and entry.needed == 1


def test_odd_rows(docs):
    got = found(docs(ODD).withColumn("w", F.lit(1)).withColumn("hits", F.lit(2)))
    assert sorted(map(repr, ((i, n, p) for i, n, p, _ in got))) == sorted(map(repr, ((i, *slow(t)) for i, t in ODD)))
    assert license_scan.scan(docs(ODD).where("false")).count() == 0


def test_no_python_on_the_path(docs):
    assert not re.search("Python|Pandas|Arrow", license_scan.scan(docs(ODD))._jdf.queryExecution().toString())
