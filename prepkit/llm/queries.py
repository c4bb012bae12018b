"""The registered queries of this package; those that SQL can express with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm import (
    decontamination,
    divergence,
    lang_id,
    license_scan,
    line_dedup,
    packing,
    quality_rules,
    ratings,
    reply_trees,
    secret_scan,
    simhash,
    url_filter,
    vector_codes,
)
from prepkit.operators.aggregates import local_frame
from prepkit.sources.scratch import materialize

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: The rules that pages are judged by (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: A conversation whose texts hold control strings (fixed values).
CONTROL_TURNS = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels' two marks; rows whose crc32 leaves 1 modulo 3 are never learnt from."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    marks = labels.select("doc_id", ratings.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ratings.train(docs, marks.where(~lang_id.held_out()), 3)
    return ratings.rate(docs, model).withColumn("held_out", lang_id.held_out())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hex_string(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["exact"])
    starts = F.flatten(F.transform(base, lambda m: m["starts"]))
    ends = F.flatten(F.transform(base, lambda m: F.transform(m["starts"], lambda s: s + m["length"] - 1)))
    found = found.select("*", base.alias("base"), starts.alias("starts"), ends.alias("ends"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        license_scan.labels(F.col("base")).alias("base_labels"),
        license_scan.labels(F.col("matches")).alias("labels"),
        "score",
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), RANK_FILE)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    return lang_id.identify(docs, model, extra={"held_out": lang_id.held_out()})


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history comes in two runs; the second scans only blobs that the first has not entered in the ledger."""
    docs = _read(spark, sf_dir, "documents")
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    ledger = secret_scan.scan(docs.where(~later))
    ledger = secret_scan.Ledger(materialize(ledger.scanned, "scanned"), ledger.findings)
    ledger = ledger.plus(secret_scan.scan(docs.where(later), ledger=ledger))
    found = secret_scan.findings_by_path(docs, ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = local_frame(spark, URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_read(spark, sf_dir, "pages"), rules)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("version").withColumn("containment", F.round("containment", 6))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(
        _read(spark, sf_dir, "documents"),
        _read(spark, sf_dir, "labels"),
        good=(F.col("quality") == 1) & (F.col("toxic") == 0),
        stratum=F.col("lang"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    kept = line_dedup.kept(F.col("row.text"), F.col("bits.keep"))
    return joined.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("bits.n_lines").alias("n_lines"),
        F.col("bits.n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings; every column is read back from the formatted text."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(local_frame(spark, CONTROL_TURNS, "conv_id bigint, turn bigint, role string, text string"))
    template = reply_trees.Template()
    found = reply_trees.format_conversations(rows, template=template)
    found = found.select(
        "tree", "formatted", template.turns(F.col("formatted")).alias("turns"),
        template.masked(F.col("formatted"), F.col("spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = materialize(vector_codes.encode(vectors, books, keep=["vec_id", "label"]), "codes")
    digest = F.lit(books.sha256() if books else None).alias("codebooks_sha256")
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash_near_dedup,
        op3_license_scan,
        op4_best_fit_packing,
        op5_language_id,
        op6_secret_scan,
        op7_url_filter,
        op8_benchmark_decontamination,
        op9_quality_rules,
        op10_line_dedup,
        op11_chat_formatting,
        op12_source_divergence,
        op13_vector_codes,
    )
}

_OP7 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules AS (
  SELECT * FROM (VALUES {", ".join(str(r) for r in URL_RULES)}) AS t(rule_host, rule_path, rule_verdict)
), best AS (
  SELECT p.page_id, p.host, p.path, max(rule_host || rule_path) FILTER (n = 1) AS rule,
    max(rule_verdict) FILTER (n = 1) AS verdict
  FROM (
    SELECT p.*, r.*, row_number() OVER (PARTITION BY p.page_id
      ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
    FROM parts p LEFT JOIN rules r
      ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  ) p GROUP BY ALL
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN list_has_any(string_split_regex(host, '[-._]+'),
    {url_filter.BLOCKED_HOST_WORDS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

_OP8 = """
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
), b AS (
  SELECT id, w, least(5, len(w)) AS k FROM (
    SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0
), widths AS (
  SELECT DISTINCT k FROM b
), ds AS (
  SELECT DISTINCT id, array_to_string(w[i : i + k - 1], ' ') AS shingle
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, widths)
), bs AS (
  SELECT DISTINCT id, array_to_string(w[i : i + k - 1], ' ') AS shingle
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared,
  round(count(*) / any_value(n.n), 6) AS containment
FROM ds d JOIN bs b ON d.shingle = b.shingle JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 5 >= any_value(n.n) * 4
"""

_OP10 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP11 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(regexp_replace(text, '(<\\*(?:\|im_start\|>|\|im_end\|>|s>|/s>)|\[\\*(?:INST\]|/INST\]))', '\1.', 'g'))
    + length(url_encode(role)) + 24 AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP12 = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS MATERIALIZED (
  SELECT lang, source, row, term, count(*) AS n
  FROM (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(n)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(*) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.n), 0) AS n_lang,
    coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source
    LEFT JOIN v ON g.lang = v.lang
  GROUP BY g.lang, g.source
), f AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
    1 + 1000000000 * (k.total + 1) // (g.n_lang + g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _op13() -> str:
    """Parts as rows of (vector, part, position); each round joins them to the codebooks by position."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for i in range(3):
        steps.append(f"""
, far{i} AS (
  SELECT vec_id, part, entry, sum((x - y) * (x - y)) AS far FROM x JOIN book{i} USING (part, pos) GROUP BY ALL
), near{i} AS MATERIALIZED (
  SELECT vec_id, part, first(entry ORDER BY far, entry) AS entry, min(far) AS far FROM far{i} GROUP BY ALL
)""")
        if i < 2:
            steps.append(f""", book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN (
    SELECT part, entry, pos, {floor} AS y FROM (
      SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM x JOIN near{i} USING (vec_id, part) GROUP BY ALL)
  ) m USING (part, entry, pos)
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, nth, i // (d // 16) AS part, i % (d // 16) AS pos, floor(256 * v::DOUBLE)::HUGEINT AS x
  FROM (SELECT vec_id, nth, len(embedding) AS d, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, nth AS entry, pos, x AS y FROM x WHERE nth < 64
){"".join(steps)}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLES = {
    "op7_url_filter": _OP7,
    "op8_benchmark_decontamination": _OP8,
    "op10_line_dedup": _OP10,
    "op11_chat_formatting": _OP11,
    "op12_source_divergence": _OP12,
    "op13_vector_codes": _op13(),
}
