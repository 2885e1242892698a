"""Licence scans with a positional index of rare words, in DataFrame expressions alone.

A licence notice is a template: its words, and a key phrase in it that must stand whole. The index leads
from a template's rarest key word (by the document frequencies of the corpus) to the template and the
place of the word in it. A document is looked up by the places of its rare licence words: each place and
posting give a start, the next rarest key word must stand at its relative place, then the key phrase is
verified and the words of the whole template are counted at theirs. A template is found where the key
phrase stands and at least ``SHARE`` of its words do.

Every key phrase contains the word it is looked up by, so nothing is missed, whichever word that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand at their places.
SHARE = 0.8

#: Base phrases, found where all their words stand.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Label, notice, key phrase; wording of the public licence texts.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]

PLACES = "array<struct<label:string,base:boolean,start:int,share:double>>"


def templates() -> list[dict]:
    rows = [(label, phrase, phrase, True) for label, phrase in BASE] + [(*notice, False) for notice in NOTICES]
    result = []
    for label, text, key, base in rows:
        words, key_words = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
        result.append({"label": label, "words": words, "key": key_words, "key_at": at, "base": base})
    return result


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null is the empty text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of a bounded list of words stands."""
    known = F.array(*map(F.lit, words))
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), known)).alias("word"))
    return {r.word: r["count"] for r in found.groupBy("word").count().collect()}


def index(frequencies: dict[str, int]) -> Column:
    """The templates with their postings, as an array literal; ties go to the earlier word."""

    def texts(words: list[str]) -> Column:
        return F.array(*map(F.lit, words))

    entries = []
    for t in templates():
        by_rarity = sorted(range(len(t["key"])), key=lambda i: (frequencies.get(t["key"][i], 0), i))
        rare, second = by_rarity[0], by_rarity[min(1, len(by_rarity) - 1)]
        entries.append(
            F.struct(
                F.lit(t["key"][rare]).alias("rare"),
                F.lit(t["key_at"] + rare).alias("rare_at"),
                F.lit(t["key"][second]).alias("second"),
                F.lit(t["key_at"] + second).alias("second_at"),
                texts(t["key"]).alias("key"),
                F.lit(t["key_at"]).alias("key_at"),
                texts(t["words"]).alias("words"),
                F.lit(t["label"]).alias("label"),
                F.lit(t["base"]).alias("base"),
            )
        )
    return F.array(*entries)


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to the licences of each document, one row per row.

    ``n_base``, ``first_word`` and ``last_word`` count and bound the places of base phrases,
    ``base_labels`` and ``labels`` are distinct, sorted and joined by commas, ``score`` is the largest
    share of a notice whose key phrase stands (0 without one). ``places`` has them all. A null or empty
    text has no words and no places.
    """
    vocabulary = sorted({w for t in templates() for w in t["key"]})
    frequencies = document_frequencies(docs, vocabulary)
    postings = index(frequencies)
    rare = sorted({min(t["key"], key=lambda w: (frequencies.get(w, 0), t["key"].index(w))) for t in templates()})
    rare_words = F.array(*map(F.lit, rare))
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    words = F.col("words")
    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda s: s["word"].isin(*rare))

    def stands(spot: Column, t: Column) -> Column:
        start = spot["at"] - t["rare_at"]
        return (
            (t["rare"] == spot["word"])
            & (start + t["key_at"] >= 0)
            & (F.get(words, start + t["second_at"]) == t["second"])
            & (F.slice(words, F.greatest(start + t["key_at"] + 1, F.lit(1)), F.size(t["key"])) == t["key"])
        )

    def place(spot: Column, t: Column) -> Column:
        start = spot["at"] - t["rare_at"]
        agree = F.filter(t["words"], lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False)))
        return F.struct(
            t["label"].alias("label"),
            t["base"].alias("base"),
            start.alias("start"),
            (F.size(agree) / F.size(t["words"])).alias("share"),
        )

    def looked_up(spot: Column) -> Column:
        return F.transform(F.filter(postings, lambda t: stands(spot, t)), lambda t: place(spot, t))

    placed = worded.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap(words, rare_words), F.flatten(F.transform(spots, looked_up))).otherwise(F.array().cast(PLACES)).alias("places"),
    )
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    notices = F.filter("places", lambda p: ~p["base"])
    found = F.filter("places", lambda p: p["base"] | (p["share"] >= SHARE))

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return placed.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels(F.filter("places", lambda p: p["base"])).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.array_max(F.transform(notices, lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def twin() -> str:
    """The same result in SQL, by comparing every place with every template."""

    def words(items: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in items) + "]"

    rows = ", ".join(f"('{t['label']}', {str(t['base']).lower()}, {words(t['words'])}, {words(t['key'])}, {t['key_at']})" for t in templates())
    return rf"""
WITH t(label, base, words, key, key_at) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS at FROM d),
k AS (SELECT i.doc_id, i.w, t.label, t.base, t.words, i.at - t.key_at AS start FROM i JOIN t ON i.w[i.at + 1] = t.key[1] WHERE i.w[i.at + 1:i.at + len(t.key)] = t.key),
p AS (SELECT doc_id, label, base, start,
  len(list_filter(range(len(words)), lambda j: start + j >= 0 AND coalesce(w[start + j + 1] = words[j + 1], false)))::double / len(words) AS share FROM k)
SELECT d.doc_id, len(d.w)::bigint AS n_words,
  count(*) FILTER (p.base)::bigint AS n_base,
  min(p.start) FILTER (p.base)::bigint AS first_word,
  max(p.start) FILTER (p.base)::bigint AS last_word,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.base OR p.share >= {SHARE}), '') AS labels,
  coalesce(max(p.share) FILTER (NOT p.base), 0.0)::double AS score
FROM d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.w"""
