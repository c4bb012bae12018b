"""Suggestion and rule-report queries."""

from __future__ import annotations

from itertools import combinations

from prepkit.functions import keywords as K
from prepkit.operators import features as X
from prepkit.operators import reports as R
from queryset.common import (
    COLUMNS,
    CUSTOMER_ROUGH,
    DOCUMENTS_HINTS,
    DOCUMENTS_ROUGH,
    EVENTS_LINE,
    LINEITEM_NUMBERS,
    TABLES,
    TEXT,
    quantile_sql,
    read,
    role_of,
    union_sql,
)
from queryset.profiling import _duplicates_sql, _missing_sql, _warnings_sql

INTEGERS = set(
    "l_orderkey l_partkey l_suppkey l_linenumber p_partkey p_size doc_id n_chars quality toxic "
    "event_id user_id conv_id turn flat k".split()
)


def _values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


def _domain_sql(src: str, group: str, text: str) -> str:
    words = ", ".join(
        f"({i}, '{domain}', {j}, '{w}')"
        for i, (domain, listed) in enumerate(K.DOMAIN_KEYWORDS.items())
        for j, w in enumerate(listed)
    )
    return f"""
WITH w(place, domain, word_no, word) AS (VALUES {words}),
hits AS (SELECT DISTINCT {group}, word FROM {src}, (SELECT DISTINCT word FROM w) WHERE contains(lower({text}), word)),
scores AS (SELECT g.{group}, w.place, w.domain, count(h.word) AS score
  FROM (SELECT DISTINCT {group} FROM {src}) g CROSS JOIN w LEFT JOIN hits h ON h.{group} = g.{group} AND h.word = w.word
  GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, place) AS rn FROM scores)
SELECT {group}, CASE WHEN score > 0 THEN domain ELSE 'General' END AS domain, score::INTEGER AS score
FROM best WHERE rn = 1"""


def _catalog_sql() -> str:
    return union_sql(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{role_of(c)}' AS role, "
        f"count(*) - count({c}) AS null_count FROM {t}"
        for t, names in COLUMNS.items()
        for c in names
    )


def _any(words) -> str:
    return f"bool_or(list_bool_or(list_transform({list(words)}, lambda w: contains(lower(column_name), w))))"


def _suitability_sql() -> str:
    return f"""
WITH f AS (SELECT table_name, count(*) AS columns, count(*) FILTER (role = 'numeric') AS numeric_columns,
  count(*) FILTER (role = 'text') AS text_columns, {_any(K.TIME_KEYWORDS)} AS has_time, {_any(K.NLP_KEYWORDS)} AS has_nlp
  FROM ({_catalog_sql()}) GROUP BY table_name),
t AS (SELECT *, list_filter([
  CASE WHEN has_time AND numeric_columns > 0 THEN 'Time Series Forecasting=High' END,
  CASE WHEN has_nlp THEN 'NLP / Text Analysis=High' END,
  CASE WHEN numeric_columns > 0 AND numeric_columns / columns >= 0.4 THEN 'Regression=High' END,
  CASE WHEN numeric_columns > 0 AND text_columns > 0 THEN 'Classification=High'
       WHEN numeric_columns > 0 THEN 'Classification=Medium' END,
  CASE WHEN numeric_columns >= 3 THEN 'Clustering=Medium' END], lambda x: x IS NOT NULL) AS tags FROM f),
c AS (SELECT *, CASE WHEN len(tags) = 0 THEN ['Exploratory Data Analysis=Medium'] ELSE tags END AS chosen FROM t)
SELECT table_name, columns, numeric_columns,
  array_to_string(list_transform(chosen, lambda x: split_part(x, '=', 1)), '; ') AS tasks,
  array_to_string(list_transform(chosen, lambda x: split_part(x, '=', 2)), '; ') AS confidence FROM c"""


def _is_id(c: str) -> bool:
    return any(c == w or c.endswith("_" + w) for w in K.ID_KEYWORDS)


def _suggestions_sql(src: str, columns) -> str:
    ids = [c for c in columns if _is_id(c)]
    numbers = [c for c in columns if c not in ids and role_of(c) == "numeric"]
    text = [c for c in columns if c not in ids and c in TEXT]
    parts = [f"SELECT '{c}' AS column_name, 'drop' AS suggestion, NULL::VARCHAR AS detail" for c in ids]
    parts += [
        f"SELECT '{c}', 'normalize', NULL FROM {src} HAVING max({c}) - min({c}) > 100" for c in numbers
    ]
    for c in text:
        share = f"count(DISTINCT {c}) / greatest(count(*), 1)"
        parts += [
            f"SELECT '{c}', 'drop', NULL FROM {src} HAVING {share} > 0.9",
            f"SELECT '{c}', 'length_feature', NULL FROM {src} HAVING {share} > 0.9",
            f"SELECT '{c}', 'encode', NULL FROM {src} HAVING {share} <= 0.9 AND count(DISTINCT {c}) <= 50",
            f"SELECT '{c}', 'hash_encoding', NULL FROM {src} HAVING {share} <= 0.9 AND count(DISTINCT {c}) > 50",
        ]
    parts += [
        f"SELECT '{a}', 'correlated', '{b}' FROM {src} HAVING min({a}) < max({a}) AND min({b}) < max({b}) AND abs(corr({a}, {b})) > 0.95"
        for a, b in combinations(numbers, 2)
    ]
    return f"SELECT * FROM ({union_sql(parts)}) s(column_name, suggestion, detail)"


def _targets_sql(src: str, columns) -> str:
    facts = union_sql(
        f"SELECT {i} AS place, '{c}' AS column_name, {str(c in TEXT or c in INTEGERS).lower()} AS counted, "
        f"count(DISTINCT {c}) AS d FROM {src}"
        for i, c in enumerate(columns)
    )
    return f"""
SELECT row_number() OVER (ORDER BY place)::INTEGER AS rank, column_name FROM ({facts}) f
WHERE EXISTS (SELECT 1 FROM (VALUES {_values(K.TARGET_KEYWORDS)}) k(w)
              WHERE starts_with(lower(column_name), w) OR ends_with(lower(column_name), w))
   OR counted AND d BETWEEN 2 AND 19
ORDER BY place"""


def _category_targets_sql(src: str, columns) -> str:
    facts = union_sql(
        f"SELECT {i} AS place, '{c}' AS column_name, {str(c in TEXT).lower()} AS is_text, "
        f"count(DISTINCT {c}) AS d, count(*) AS n FROM {src}"
        for i, c in enumerate(columns)
    )
    return f"""
SELECT row_number() OVER (ORDER BY place)::INTEGER AS rank, column_name FROM ({facts}) f
WHERE EXISTS (SELECT 1 FROM (VALUES {_values(K.TARGET_HINTS)}) k(w) WHERE contains(lower(column_name), w))
   OR is_text AND d < least(n * 0.2::DOUBLE, 50) AND d BETWEEN 2 AND 49
ORDER BY place"""


def _facts_sql(src: str, names, numbers, text) -> str:
    high = " + ".join(f"(CASE WHEN count(*) - count({c}) > count(*) * 0.5 THEN 1 ELSE 0 END)" for c in names)
    low = " + ".join(
        f"(CASE WHEN avg({c}) <> 0 THEN (CASE WHEN abs(stddev_samp({c}) / avg({c})) < 0.01 THEN 1 ELSE 0 END) "
        f"WHEN stddev_samp({c}) = 0 THEN 1 ELSE 0 END)"
        for c in numbers
    )
    many = " + ".join(
        f"(SELECT CASE WHEN count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) > 0.05 "
        f"THEN 1 ELSE 0 END FROM {src}, (SELECT {quantile_sql(c, 0.25)} AS q1, {quantile_sql(c, 0.75)} AS q3 FROM {src}))"
        for c in numbers
    )

    def listed(part: str) -> str:
        return "concat_ws(', ', " + ", ".join(part.split(" + ")) + ")"

    lists = {
        "missing_names": " + ".join(f"CASE WHEN count(*) > count({c}) THEN '{c}' END" for c in names),
        "high_names": " + ".join(f"CASE WHEN count(*) - count({c}) > count(*) * 0.5 THEN '{c}' END" for c in names),
        "low_names": " + ".join(
            f"CASE WHEN avg({c}) <> 0 AND abs(stddev_samp({c}) / avg({c})) < 0.01 OR avg({c}) = 0 AND stddev_samp({c}) = 0 THEN '{c}' END"
            for c in numbers
        ),
    }
    lists = ", ".join(f"{listed(v)} AS {k}" for k, v in lists.items())
    outlier_names = "concat_ws(', ', " + ", ".join(
        f"(SELECT CASE WHEN count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) > 0.05 "
        f"THEN '{c}' END FROM {src}, (SELECT {quantile_sql(c, 0.25)} AS q1, {quantile_sql(c, 0.75)} AS q3 FROM {src}))"
        for c in numbers
    ) + ")"
    place = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(text))
    tiers = ", ".join(
        f"(SELECT string_agg(column_name, ', ' ORDER BY CASE column_name {place} END) "
        f"FROM ({_warnings_sql(src, text)}) WHERE severity = '{tier}') AS {name}"
        for tier, name in (("SEVERE", "severe_names"), ("WARNING", "mild_names"))
    )
    return f"""
SELECT m.row_count, h.missing_names, h.high_names, h.low_names, {outlier_names} AS outlier_names, {tiers}, {len(names)} AS column_count, m.missing_cells, d.duplicate_rows, h.high, h.low,
  {many} AS outliers,
  (SELECT count(*) FROM ({_warnings_sql(src, text)}) WHERE severity = 'SEVERE') AS severe,
  (SELECT count(*) FROM ({_warnings_sql(src, text)}) WHERE severity = 'WARNING') AS mild
FROM ({_missing_sql(src, names)}) m, ({_duplicates_sql(src)}) d,
  (SELECT {high} AS high, {low} AS low, {lists} FROM {src}) h"""


def _readiness_sql(facts: str) -> str:
    return f"""
WITH f AS ({facts}),
t AS (SELECT
  greatest(0.0, 25 * (1 - 4 * (missing_cells / (row_count * column_count))))::DOUBLE AS missing,
  greatest(0.0, 15 * (1 - 5 * (duplicate_rows / row_count)))::DOUBLE AS duplicates,
  (15 * greatest(0.0, 1 - high / column_count))::DOUBLE AS consistency,
  greatest(0.0, 20 - severe * 10 - mild * 3)::DOUBLE AS imbalance,
  (15 * greatest(0.0, 1 - low / column_count))::DOUBLE AS variance,
  greatest(0.0, 10 - outliers * 2)::DOUBLE AS outliers FROM f)
SELECT round(missing, 1) AS missing_score, round(duplicates, 1) AS duplicates_score,
  round(consistency, 1) AS consistency_score, round(imbalance, 1) AS imbalance_score,
  round(variance, 1) AS variance_score, round(outliers, 1) AS outliers_score,
  greatest(0, least(100, round_even(missing + duplicates + consistency + imbalance + variance + outliers, 0)::INTEGER)) AS readiness_score
FROM t"""


def _recommendations_sql(facts: str) -> str:
    rules = {
        "plan_missing_values": "mr >= 0.05",
        "remove_duplicates": "duplicate_rows > 0",
        "resample_severe_imbalance": "severe > 0",
        "watch_mild_imbalance": "severe = 0 AND mild > 0",
        "impute_before_training": "mr > 0.05",
        "prevent_duplicate_leakage": "dr > 0.01",
        "drop_half_empty_columns": "high > 0",
        "drop_flat_columns": "low > 0",
        "treat_outliers": "outliers > 0",
        "ready_for_modeling": "mr <= 0.05 AND dr <= 0.01 AND high = 0 AND severe = 0 AND low = 0",
    }
    about = {
        "plan_missing_values": "missing_names",
        "impute_before_training": "missing_names",
        "resample_severe_imbalance": "severe_names",
        "watch_mild_imbalance": "mild_names",
        "drop_half_empty_columns": "high_names",
        "drop_flat_columns": "low_names",
        "treat_outliers": "outlier_names",
    }
    rows = union_sql(
        f"SELECT '{k}' AS rule, {v} AS fired, CASE WHEN {v} THEN {about.get(k, 'NULL::VARCHAR')} END AS columns FROM g"
        for k, v in rules.items()
    )
    return f"""
WITH f AS ({facts}),
g AS (SELECT *, missing_cells / (row_count * column_count) AS mr, duplicate_rows / row_count AS dr FROM f)
{rows}"""


def _catalog(s, d):
    return R.catalog({t: read(s, d, t) for t in TABLES})


_rough = DOCUMENTS_ROUGH
_rough_facts = _facts_sql(
    _rough.sql(), _rough.columns, ["doc_id", "n_chars", "flat"], ["text", "lang", "source"]
)
_customer_facts = _facts_sql(
    CUSTOMER_ROUGH.sql(),
    COLUMNS["customer"],
    ["c_custkey", "c_nationkey", "c_acctbal"],
    ["c_name", "c_mktsegment"],
)
_conv_facts = _facts_sql("conversations", COLUMNS["conversations"], ["conv_id", "turn"], ["role", "text"])
_line = EVENTS_LINE.columns

QUERIES = {
    "feature_suggestions_lineitem": lambda s, d: X.feature_suggestions(read(s, d, "lineitem")),
    "feature_suggestions_documents": lambda s, d: X.feature_suggestions(_rough.load(s, d)),
    "feature_suggestions_events": lambda s, d: X.feature_suggestions(EVENTS_LINE.load(s, d)),
    "target_columns_lineitem": lambda s, d: X.target_columns(read(s, d, "lineitem")),
    "target_columns_labels": lambda s, d: X.target_columns(read(s, d, "labels")),
    "target_columns_documents": lambda s, d: X.target_columns(_rough.load(s, d)),
    "target_columns_by_category": lambda s, d: X.category_targets(read(s, d, "lineitem")),
    "target_columns_by_hint": lambda s, d: X.category_targets(DOCUMENTS_HINTS.load(s, d)),
    "text_length_feature": lambda s, d: X.text_length(read(s, d, "documents"), "text"),
    "hash_encode": lambda s, d: X.hash_encode(read(s, d, "pages"), "url", 32),
    "domain_tag_documents": lambda s, d: R.domain_tags(read(s, d, "documents"), ["source"], "text"),
    "domain_tag_each_document": lambda s, d: R.domain_tags(
        read(s, d, "documents"), ["doc_id"], "text"
    ),
    "domain_tag_catalog": lambda s, d: R.domain_tags(_catalog(s, d), ["table_name"], "column_name"),
    "catalog_columns": _catalog,
    "suitability_flags": lambda s, d: R.suitability(_catalog(s, d)),
    "readiness_score": lambda s, d: R.readiness_score(_rough.load(s, d)),
    "readiness_score_customer": lambda s, d: R.readiness_score(CUSTOMER_ROUGH.load(s, d)),
    "readiness_score_conversations": lambda s, d: R.readiness_score(read(s, d, "conversations")),
    "recommendations": lambda s, d: R.recommendations(_rough.load(s, d)),
    "recommendations_conversations": lambda s, d: R.recommendations(read(s, d, "conversations")),
}

ORACLES = {
    "feature_suggestions_lineitem": _suggestions_sql("lineitem", COLUMNS["lineitem"]),
    "feature_suggestions_documents": _suggestions_sql(_rough.sql(), _rough.columns),
    "feature_suggestions_events": _suggestions_sql(EVENTS_LINE.sql(), _line),
    "target_columns_lineitem": _targets_sql("lineitem", COLUMNS["lineitem"]),
    "target_columns_labels": _targets_sql("labels", COLUMNS["labels"]),
    "target_columns_documents": _targets_sql(_rough.sql(), _rough.columns),
    "target_columns_by_category": _category_targets_sql("lineitem", COLUMNS["lineitem"]),
    "target_columns_by_hint": _category_targets_sql(
        DOCUMENTS_HINTS.sql(), DOCUMENTS_HINTS.columns
    ),
    "text_length_feature": "SELECT *, length(text)::INTEGER AS text_length FROM documents",
    "hash_encode": (
        "SELECT *, CAST(('0x' || substr(md5(url), 1, 8)) AS BIGINT) % 32 AS url_hash FROM pages"
    ),
    "domain_tag_documents": _domain_sql("documents", "source", "text"),
    "domain_tag_each_document": _domain_sql("documents", "doc_id", "text"),
    "domain_tag_catalog": _domain_sql(f"({_catalog_sql()})", "table_name", "column_name"),
    "catalog_columns": _catalog_sql(),
    "suitability_flags": _suitability_sql(),
    "readiness_score": _readiness_sql(_rough_facts),
    "readiness_score_customer": _readiness_sql(_customer_facts),
    "readiness_score_conversations": _readiness_sql(_conv_facts),
    "recommendations": _recommendations_sql(_rough_facts),
    "recommendations_conversations": _recommendations_sql(_conv_facts),
}
