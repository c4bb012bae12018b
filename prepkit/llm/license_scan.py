"""Licence notices in texts by a positional index of rare words. DataFrame functions only.

Every template is a run of words. Its rarest words (highest IDF over the scanned texts) are its
index entries, kept with their relative positions. A text looks up where those words stand; each
entry proposes a start for the template; starts on which enough entries agree are candidates,
whose mandatory phrases are then verified word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR_CHARS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence text to look for; ``phrases`` are mandatory and stand where the template has them.

    ``exact`` templates must match in every word and are the base labels.
    """

    label: str
    text: str
    phrases: tuple[str, ...] = field(default=())
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]

    def phrase_places(self) -> list[tuple[int, list[str]]]:
        """Start in the template and words of each mandatory phrase."""
        words, found = self.words, []
        for phrase in self.phrases:
            own = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            found.append((at, own))
        return found


#: The phrases of the base labels (fixed values).
PHRASES = [
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
]
#: Well-known notices, as their licences or the SPDX list give them (fixed values).
NOTICES = [
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "any person obtaining a copy"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "is hereby granted"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "cc-by-sa-4.0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike 4 0",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software",),
    ),
]


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null is empty."""
    inner = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_SEPARATOR_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def rarity(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, float]:
    """The IDF of each vocabulary word over all texts; the result has one entry per given word."""
    held = F.array_intersect(words(F.col(text_col)), F.lit(list(vocabulary)))
    counted = docs.select(F.explode(F.array_append(held, "")).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counted}
    total = seen.pop("", 0)
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}


@dataclass(frozen=True)
class IndexEntry:
    template: Template
    rare: tuple[tuple[int, str], ...]  # place and word of the index entries
    needed: int  # entries that must agree on a start


def build_index(templates: Sequence[Template], idf: dict[str, float], entries: int = 4, agree: int = 3) -> list[IndexEntry]:
    """Choose each template's rarest words, the first of equals, ``agree`` of which must meet.

    An exact template has one entry, its rarest word: every occurrence holds it.
    """
    index = []
    for t in templates:
        ranked = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))
        kept = sorted(ranked[: 1 if t.exact else entries])
        index.append(IndexEntry(t, tuple((i, t.words[i]) for i in kept), 1 if t.exact else min(agree, len(kept))))
    return index


def _all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _proposed(word: str, place: int) -> Column:
    """Template starts that the hits of one index entry propose."""
    own = F.filter("hits", lambda h: h["word"] == word)
    return F.transform(own, lambda h: h["at"] - place)


def _share(template: Template, idf: dict[str, float]):
    """Of a start, 0.5 plus half the share of the template's IDF that stands at its places."""
    total = sum(idf[w] for w in template.words)

    def share(start: Column) -> Column:
        stands = [
            F.when(F.get("w", start + i) == w, idf[w] / total).otherwise(0.0) for i, w in enumerate(template.words)
        ]
        return 0.5 + 0.5 * sum(stands, F.lit(0.0))

    return share


def _labelled(label: str) -> Column:
    return F.filter("matches", lambda m: m["label"] == label)


def _starts(entry: IndexEntry) -> Column:
    """Where the template starts in ``w``: candidates by agreeing entries, then verified phrases."""
    starts = [_proposed(word, place) for place, word in entry.rare]
    proposed = F.array_distinct(F.concat(*starts))

    def word_at(start: Column, place: int, word: str) -> Column:
        return F.coalesce(F.get("w", start + place) == word, F.lit(False))

    def verified(start: Column) -> Column:
        agreeing = sum((word_at(start, p, w).cast("int") for p, w in entry.rare), F.lit(0))
        exact = list(enumerate(entry.template.words)) if entry.template.exact else []
        mandatory = [(at + i, w) for at, own in entry.template.phrase_places() for i, w in enumerate(own)]
        return _all_of([agreeing >= entry.needed, *(word_at(start, p, w) for p, w in exact or mandatory)])

    return F.array_sort(F.filter(proposed, verified))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[Template] = tuple(PHRASES),
    notices: Sequence[Template] = tuple(NOTICES),
    entries: int = 4,
    agree: int = 3,
) -> DataFrame:
    """``(id_col, n_words, matches, score)`` for every row.

    ``matches`` holds, per template found, a struct of its ``label``, whether it is ``exact``, its
    length in words, and all its ``starts`` (word positions from 0, ascending) in the whole text. ``score`` is
    0 without a match; an exact phrase counts 0.5, a notice 0.5 plus half the share of its words' IDF
    that stands at their relative positions, and the best counts.

    Two passes over the texts: document frequencies of the templates' words, then the search,
    which shuffles nothing; a text's work grows with its words and hits alone. Null and empty
    texts have no words; an empty table gives no rows; repeated rows are answered each.
    """
    templates = [*phrases, *notices]
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = rarity(docs, text_col, vocabulary)
    index = build_index(templates, idf, entries, agree)
    rare = sorted({word for e in index for _, word in e.rare})

    split = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    at = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.transform(
        F.filter(at, lambda i: F.get("w", i).isin(rare)), lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"))
    )
    looked_up = split.select("id", "w", F.size("w").alias("n_words"), F.when(F.arrays_overlap("w", F.lit(rare)), hits).alias("hits"))
    matches, scores = [], []
    for e in index:
        starts = F.when(F.col("hits").isNotNull(), _starts(e))
        matches.append(
            F.struct(
                F.lit(e.template.label).alias("label"),
                F.lit(e.template.exact).alias("exact"),
                F.lit(len(e.template.words)).alias("length"),
                starts.alias("starts"),
            )
        )
    found = looked_up.select("id", "w", "n_words", F.array(*matches).alias("tried"))
    found = found.select("id", "w", "n_words", F.filter("tried", lambda m: F.size(m["starts"]) > 0).alias("matches"))
    for e in index:
        own = _labelled(e.template.label)
        if e.template.exact:
            scores.append(F.when(F.size(own) > 0, 0.5))
        else:
            shares = F.transform(F.get(own, 0)["starts"], _share(e.template, idf))
            scores.append(F.when(F.size(own) > 0, F.array_max(shares)))
    best = F.least(F.array_max(F.array(*scores, F.lit(0.0))), F.lit(1.0))
    score = F.when(F.size("matches") > 0, best).otherwise(0.0)
    return found.select(F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), "matches", score.alias("score"))


def labels(matches: Column) -> Column:
    """The distinct labels of matches, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
