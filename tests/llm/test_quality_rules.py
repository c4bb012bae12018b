import collections
import math
import random
import re

from pyspark.sql import functions as F

from prepkit.llm import quality_rules
from prepkit.llm.quality_rules import Rule
from tests.llm.conftest import ODD

SPACE = " \t\n\x0b\x0c\r"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def counts(frame):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [(r["doc_id"], tuple(r[n] for n in names)) for r in quality_rules.metrics(frame).collect()]


def test_metrics_of_the_corpus(docs, corpus):
    assert dict(counts(docs(corpus))) == {i: slow(t) for i, t in corpus}


def test_metrics_of_random_texts(docs):
    rng = random.Random(17)
    pool = ["a", "b", "c", "#x", "é", "a", "\n", "d e f", " a", "\t", "\x0b"]
    rows = [(i, "".join(x + rng.choice([" ", "\n", ""]) for x in rng.choices(pool, k=rng.randint(0, 60)))) for i in range(300)]
    assert dict(counts(docs(rows))) == {i: slow(t) for i, t in rows}


def test_odd_rows(docs):
    frame = docs(ODD).withColumn("n_words", F.lit(1)).withColumn("h", F.lit(2)).withColumn("stratum", F.lit("x"))
    assert sorted(map(repr, counts(frame))) == sorted(repr((i, slow(t))) for i, t in ODD)
    assert quality_rules.metrics(frame.where("false")).count() == 0


def cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_distribution(spark):
    cases = [(0, 1), (0, 500), (3, 500), (20, 500), (5, 5), (40, 3000)]
    frame = spark.createDataFrame(cases, "k bigint, n bigint")
    for p in (0.01, 0.05, 0.5):
        rows = frame.select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), p).alias("log")).collect()
        for r in rows:
            want = cdf(r["k"], r["n"], p)
            assert abs(r["log"] - math.log(want)) < 1e-6 if want > 1e-300 else r["log"] < -690


def test_strictest_admissible_cutoff(spark):
    """By hand: with one test per rule and cutoff, what the exact bound allows, and nothing beyond."""
    rng = random.Random(19)
    values = {"a": [rng.random() for _ in range(2000)], "b": [rng.random() for _ in range(30)], None: [rng.random() for _ in range(1500)]}
    holdout = spark.createDataFrame([(s, v) for s, vs in values.items() for v in vs], "stratum string, m double")
    grid = tuple(i / 50 for i in range(1, 50))
    rules = [Rule("high", "m", grid), Rule("low", "m", grid, above=False)]
    found = {(r["rule"], r["stratum"]): r for r in quality_rules.thresholds(holdout, rules, risk=0.2).collect()}
    error = 0.05 / (2 * len(grid) * 3)
    for rule in rules:
        for s, vs in values.items():
            wrong = {c: sum(v > c if rule.above else v < c for v in vs) for c in grid}
            allowed = [c for c in grid if wrong[c] <= 0.1 * len(vs) and cdf(wrong[c], len(vs), 0.1) <= error]
            want = (min(allowed) if rule.above else max(allowed)) if allowed else None
            got = found.get((rule.name, s))
            assert (got and got["cutoff"]) == want
            assert not got or (got["n"], got["rejected"]) == (len(vs), wrong[got["cutoff"]])
    assert ("high", "b") not in found and ("high", "a") in found and ("low", None) in found


def test_judgement_uses_strata_and_base_rules(docs, spark):
    rng = random.Random(23)
    text = lambda symbols: " ".join(f"w{rng.randrange(10**6)}" + "#" * symbols for _ in range(60))
    rows = [(i, text(0)) for i in range(1500)] + [(5000 + i, text(5)) for i in range(20)] + [(6000, "short"), (6001, "same three words " * 40)]
    frame = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    labels = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    judged = {r["doc_id"]: r for r in quality_rules.judge(frame, labels, F.col("quality") == 1, F.col("lang"), risk=0.1).collect()}
    assert all(judged[i]["kept"] for i in range(1500))
    assert all(not judged[5000 + i]["kept"] and "symbols" in judged[5000 + i]["failed"] for i in range(20))
    assert judged[6000]["base_failed"] and judged[6001]["base_failed"] and not judged[6001]["kept"]
    few = quality_rules.judge(frame, labels.limit(5), F.col("quality") == 1, F.col("lang")).where("kept").count()
    none = quality_rules.judge(frame, labels.where("false"), F.col("quality") == 1, F.col("lang")).where("kept").count()
    assert few == none == 1520
    assert quality_rules.judge(docs(ODD), labels, F.col("quality") == 1, F.col("lang")).where("kept").count() == 0
    assert quality_rules.judge(frame.where("false"), labels, F.col("quality") == 1, F.col("lang")).count() == 0


def test_no_python_on_the_path(docs, spark):
    labels = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = quality_rules.judge(docs(ODD), labels, F.col("quality") == 1, F.col("lang"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_binomial_distribution_of_many_trials(spark):
    """As by a sum over all terms, up to the mean, where no cap on labels keeps n small."""
    cases = [(0, 250_000), (1900, 250_000), (2083, 250_000), (2500, 250_000), (16, 2000), (15, 2000), (17, 2041)]

    def want(k, n, p):
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        return max(logs) + math.log(math.fsum(math.exp(x - max(logs)) for x in logs))

    frame = spark.createDataFrame(cases, "k bigint, n bigint")
    p = 0.05 / 6
    rows = frame.select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), p).alias("log")).collect()
    for r in rows:
        if r["k"] <= r["n"] * p:
            assert abs(r["log"] - want(r["k"], r["n"], p)) < 1e-6
    # millions of rejections are a few thousand terms
    huge = spark.createDataFrame([(49_990_000, 1_000_000_000)], "k bigint, n bigint")
    log = huge.select(quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("log")).first()["log"]
    assert abs(log - math.log(0.5 * math.erfc(10_000 / math.sqrt(2 * 1e9 * 0.05 * 0.95)))) < 0.01


def test_all_labels_count(docs, spark, monkeypatch):
    """More labels than the 200,000 that the holdout was once thinned to: a small stratum keeps all its evidence."""
    seen = {}
    real = quality_rules.thresholds
    monkeypatch.setattr(quality_rules, "thresholds", lambda holdout, *a: seen.setdefault("n", holdout.count()) and real(holdout, *a))
    frame = docs([(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(1300)])
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    quality_rules.judge(frame, labels, F.col("quality") == 1, F.col("lang"))
    assert seen["n"] == 1300
