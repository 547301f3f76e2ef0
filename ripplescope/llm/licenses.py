"""Licence scan: a positional index of rare words, then phrase checks. Native."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# Phrases whose consecutive words are a licence statement.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Fixed values: (label, template, mandatory key phrase within the template).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "must retain the above copyright notice"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "to endorse or promote products"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("agpl-3", "gnu affero general public license version 3", "affero general public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
]


def idf(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents that hold each of ``words``, over all of ``docs(text)``; a bounded result."""
    found = docs.select(F.explode(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, words)))).alias("w"))
    counts = dict(found.groupBy("w").count().collect())
    return {w: counts.get(w, 0) for w in words}


def _anchors(phrase: list[str], rare: dict[str, int]) -> list[str]:
    """The two rarest words of a phrase that has to stand in full, the rarest first."""
    return sorted(set(phrase), key=lambda w: (rare[w], phrase.index(w)))[:2]


def _key_at(template: list[str], key: list[str]) -> int:
    return next(i for i in range(len(template)) if template[i : i + len(key)] == key)


def _starts(entries: Column, template: list[str], key: list[str], rare: dict[str, int]) -> Column:
    """Places where the template would start, by both of the rarest words of its mandatory phrase."""
    at = _key_at(template, key)

    def told(anchor: str) -> Column:
        hits = F.filter(entries, lambda e: e["w"] == F.lit(anchor))
        shifted = lambda o: F.transform(hits, lambda e: e["i"] - F.lit(o))
        return reduce(F.array_union, [shifted(at + i) for i, w in enumerate(key) if w == anchor])

    return reduce(F.array_intersect, map(told, _anchors(key, rare)))


def _matched(words: Column, start: Column, template: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((F.get(words, start + F.lit(i)) == F.lit(w)).cast("int"), F.lit(0)) for i, w in enumerate(template)])


def _in_full(words: Column, starts: Column, phrase: list[str]) -> Column:
    return F.filter(starts, lambda s: _matched(words, s, phrase) == len(phrase))


def _shares(words: Column, starts: Column, template: list[str], key: list[str]) -> Column:
    """Share of the template's words that stand at their places, 0 where the key phrase doesn't."""
    at = _key_at(template, key)
    verified = lambda s: _matched(words, s + F.lit(at), key) == len(key)
    return F.transform(starts, lambda s: F.when(verified(s), _matched(words, s, template) / F.lit(float(len(template)))).otherwise(F.lit(0.0)))


def license_scan(docs: DataFrame, share: float = 0.75) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its licence statements.

    Words are runs of digits, ASCII letters and other characters from U+0080 on,
    A-Z lower-cased. First the documents that hold each licence word are counted
    over all rows. A file is then looked up by those of its licence words that are the
    rarest of a mandatory phrase, and so of the highest IDF that a file which has the
    phrase can be looked up by; the two rarest words of the phrase have to agree on
    where a template starts, by their relative positions, before its other words are
    looked at. The template counts from ``share`` of its words on if its mandatory
    phrase stands at its place. Base phrases count only in full.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``; score is the largest share of a template that was accepted. A null or
    empty text has no words, no labels and score 0. Repeated rows give repeated
    results; an empty table gives none; other columns are not carried. Rows are not
    shuffled, so hot sources and long texts cost no more than their own bytes.
    """
    base = [(label, phrase.split()) for label, phrase in BASE]
    templates = [(label, t.split(), key.split()) for label, t, key in TEMPLATES]
    vocabulary = sorted({w for _, t in base for w in t} | {w for _, t, _ in templates for w in t})
    rare = idf(docs, vocabulary)
    phrases = [t for _, t in base] + [key for _, _, key in templates]
    first, anchors = sorted({_anchors(p, rare)[0] for p in phrases}), sorted({w for p in phrases for w in _anchors(p, rare)})

    text = F.coalesce(F.col("text"), F.lit(""))
    maybe = F.rlike(text, F.lit("(?i)" + "|".join(map(re.escape, first))))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(maybe, F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_w"))
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1)).otherwise(F.array().cast("array<int>"))
    entries = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), F.get("_w", i).alias("w"))), lambda e: e["w"].isin(anchors))
    out = out.withColumn("_e", entries)
    words, e = F.col("_w"), F.col("_e")
    exact = {}
    for k, (_, t) in enumerate(base):
        exact[k] = _in_full(words, _starts(e, t, t, rare), t)
    out = out.withColumns({f"_b{k}": v for k, v in exact.items()})
    best = {}
    for k, (_, t, key) in enumerate(templates):
        best[f"_t{k}"] = F.coalesce(F.array_max(_shares(words, _starts(e, t, key, rare), t, key)), F.lit(0.0))
    out = out.withColumns(best)
    starts = F.concat(*[F.col(f"_b{k}") for k in range(len(base))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(base)]))
    more = F.array_compact(F.array(*[F.when(F.col(f"_t{k}") >= share, F.lit(label)) for k, (label, _, _) in enumerate(templates)]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(*[F.when(F.col(f"_t{k}") >= share, F.col(f"_t{k}")).otherwise(F.lit(0.0)) for k in range(len(templates))], F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, more)).alias("labels"), score.alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
