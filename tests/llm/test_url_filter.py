import random
import re

from pyspark.sql import functions as F

from prepkit.llm import url_filter
from prepkit.llm.queries import URL_RULES

WORDS = set(url_filter.BLOCKED_HOST_WORDS)


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    return host, path, None, "block" if WORDS & set(re.split("[-._]+", host)) else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, table).collect()}


URLS = [
    None, "", "no scheme", "http://", "http:///en/1", "https://example.org", "https://example.org/", "https://EXAMPLE.org/en/17?x=/es/",
    "ftp://a.b.example.org/es/x", "https://notexample.org/es/", "https://example.org.com/fr/1", "http://com/fr/", "http://x.com/fr", "http://x.com/de/#f",
    "http://spam-farm.example.net/", "http://spammy.example.net/", "https://m.adult-x.example.com/es/", "a://b://example.org/es/", "https://example.org?/es/",
    "http://org/\nes/", "https://" + "a." * 5000 + "org/" + "p" * 100_000, "https://example.org/ES/", "https://exämple.org/en/1", "https://.org/", "https://org./",
]


def test_contract_rules(spark):
    got = judged(spark, URLS, URL_RULES)
    assert got == {i: slow(u, URL_RULES) for i, u in enumerate(URLS)}


def test_random_rules_and_urls(spark):
    rng = random.Random(13)
    label = lambda: rng.choice(["a", "b", "cc", "d-e", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "é"]) for _ in range(rng.randint(0, 3)))
    rules = list({(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)})
    urls = [f"http://{host()}{path()}" for _ in range(1500)]
    want = {i: slow(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want
    assert sum(w[2] is not None for w in want.values()) > 300


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    want = judged(spark, URLS, URL_RULES)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert judged(spark, URLS, URL_RULES) == want


def test_odd_tables(spark):
    rules = [("org", "/", "allow"), ("org", "/", "allow"), (None, "/", "block"), ("org", None, "block")]
    assert judged(spark, ["http://x.org/"], rules)[0] == ("x.org", "/", "org/", "allow")
    assert judged(spark, ["http://x.org/"], [("org", "/", "block"), ("org", "/", "allow")])[0][3] == "block"
    pages = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, None)], "page_id bigint, url string")
    pages = pages.withColumn("host", F.lit("h")).withColumn("rule", F.lit("r")).withColumn("page", F.lit(1))
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.judge(pages, empty).collect()] == ["allow"] * 3
    assert url_filter.judge(pages.where("false"), empty).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, empty, default="block").collect()} == {"block"}


def test_no_python_on_the_path(spark, table):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plan = url_filter.judge(table("pages"), rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_prefixes_propose_and_digests_confirm(spark, monkeypatch):
    """With prefixes of one hex digit nearly every expression meets rules of others; only equal digests count."""
    monkeypatch.setattr(url_filter, "PREFIX_CHARS", 1)
    rng = random.Random(21)
    parts = ["a", "b", "c", "org", "example"]
    rules = [(".".join(rng.choices(parts, k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 5))), rng.choice(["allow", "block"])) for _ in range(80)]
    urls = [f"http://{'.'.join(rng.choices(parts, k=rng.randint(1, 4)))}/{''.join(rng.choices('xy/', k=rng.randint(0, 8)))}" for _ in range(300)]
    for limit in (0, 1000):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
        assert judged(spark, urls, rules) == {i: slow(u, rules) for i, u in enumerate(urls)}


def test_the_join_is_on_short_prefixes(spark):
    pages = spark.range(5).select(F.concat(F.lit("x"), "id").alias("e"))
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    found = url_filter._looked_up(
        url_filter._digested(pages, "rule", "e"),
        url_filter._digested(rules.withColumn("held", F.lit(1)), "rule", "path").select("short", "digest", "held"),
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "short" in join and "digest" not in join


def test_a_hot_page_and_many_path_lengths(spark):
    rules = [("org", "/" + "p" * n, "block" if n % 2 else "allow") for n in range(40)]
    urls = ["http://a.org/ppp"] * 500 + [None] * 300 + ["http://b.org/" + "p" * n for n in range(60)]
    assert judged(spark, urls, rules) == {i: slow(u, rules) for i, u in enumerate(urls)}
