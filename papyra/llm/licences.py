"""Licence notices by a positional index of rare template words. DataFrame functions only.

1. The document frequency of every template word is counted over all documents; its IDF follows. Of each
   template the RARE words of highest IDF are its index entries: (word, template, position).
2. A document's words that are in the index are looked up; one whose indexed words cannot reach MIN_SHARE of any
   template, and that has no word of a base phrase, is done. A hit at document position i and template position
   j votes for the template at shift i - j. Votes of equal (document, template, shift) lie at the same relative
   positions; the share of the template's indexed IDF that they hold is the match's score.
3. A match of MIN_SHARE or more counts when a mandatory key phrase of its template stands at its place: among the words
   that the template covers there, and SLACK words on either side.

Base labels come from fixed phrases: a place is where a phrase's words stand consecutively. The words of each
phrase that its template may lack are always indexed, so every place is found.

Null text counts as empty. Null, empty and licence-free texts have no labels, score 0 and null places. Repeated
rows are judged each on their own. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dist import stage

RARE, MIN_SHARE, SLACK = 12, 0.6, 12
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases and the labels they give; the second word list names the word that must be indexed.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
ANCHORS = {"under the mit license": "mit", "apache license version 2": "apache", "cc by nc": "nc"}

#: Notices that public licences ask to be put into a work, with the key phrases of which one must be present.
TEMPLATES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["either version 3 of the license", "gnu general public license version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["either version 2 of the license", "gnu general public license version 2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike", "cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4", "creative commons attribution license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, SMALL)
    return F.filter(F.split(low, NO_WORD), lambda w: w != "")


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def document_frequency(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and those that hold each word of the vocabulary; a row for each word reaches the driver."""
    own = words.select(F.explode(F.array_append(F.array_intersect("words", _literal(vocabulary)), "")).alias("word"))
    count = {r.word: r.n for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return count.pop("", 0), count


def index(templates: list[tuple[str, str, list[str]]], n_docs: int, df: dict[str, int], rare: int = RARE) -> list[tuple[str, int, int, float]]:
    """(word, template, position, share of the template's indexed IDF). Ties of IDF go to the earlier word."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        own = text.split(" ")
        idf = [math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in own]
        top = sorted(range(len(own)), key=lambda j: (-idf[j], j))[:rare]
        out += [(own[j], t, j, idf[j] / sum(idf[k] for k in top)) for j in sorted(top)]
    return out


def _places(phrase: str) -> Column:
    own = phrase.split(" ")
    n = F.size("words")
    stands = lambda i: reduce(lambda a, b: a & b, (F.get("words", i + k) == w for k, w in enumerate(own)))
    return F.when(n >= len(own), F.filter(F.sequence(F.lit(0), n - len(own)), stands)).otherwise(F.array().cast("array<int>"))


def _may_match(entries: list[tuple[str, int, int, float]], n: int, min_share: float) -> Column:
    """Whether a document's indexed words, wherever they stand, could reach the share of some template, or it has a base phrase's word."""
    tests = [F.array_contains("present", w) for w in ANCHORS.values()]
    for t in range(n):
        own = [(w, share) for w, k, _, share in entries if k == t]
        held = reduce(lambda a, b: a + b, (F.when(F.array_contains("present", w), share).otherwise(0.0) for w, share in own))
        tests.append((F.size("present") > 0) & (held >= min_share - 1e-9))
    return reduce(lambda a, b: a | b, tests)


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, rare: int = RARE, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    spark = docs.sparkSession
    for label, text, keys in templates:
        if not re.fullmatch("[0-9a-z ]+", text) or not keys:
            raise ValueError(f"template {label} needs words and a key phrase")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    n_docs, df = document_frequency(split, sorted({w for _, text, _ in templates for w in text.split(" ")}))
    entries = index(templates, n_docs, df, rare)
    wanted = sorted({w for w, *_ in entries} | set(ANCHORS.values()))
    marked = split.withColumn("present", F.array_intersect("words", _literal(wanted)))
    candidate = _may_match(entries, len(templates), min_share)
    marked = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(candidate, F.col("words")).alias("words"))
    marked = stage(marked, "licences")

    held = marked.where(F.col("words").isNotNull())
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(j).alias("place"), F.lit(s).alias("share")) for w, t, j, s in entries))
    table = F.broadcast(spark.range(1).select(F.inline(rows)))  # RARE entries for each template: fixed
    votes = held.select("row", F.posexplode("words").alias("at", "word")).join(table, "word")
    matches = votes.groupBy("row", "template", (F.col("at") - F.col("place")).alias("shift")).agg(F.sum("share").alias("share")).where(F.col("share") >= min_share)
    best = matches.groupBy("row").agg(F.collect_set(F.struct("template", "shift", F.round("share", 6).alias("share"))).alias("matches"))  # fewer than the document's words

    base = F.concat(*(F.transform(_places(p), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))) for p, label in BASE.items()))
    sizes = F.array(*(F.lit(len(text.split(" "))) for _, text, _ in templates))
    begin = lambda m: F.greatest(m.shift - SLACK, F.lit(0))
    covered = lambda m: F.slice("words", begin(m) + 1, m.shift + F.get(sizes, m.template) + SLACK - begin(m))
    near = F.transform("matches", lambda m: F.struct(m.template.alias("template"), m.share.alias("share"), F.concat(F.lit(" "), F.array_join(covered(m), " "), F.lit(" ")).alias("text")))
    found = held.join(best, "row", "left").select("doc_id", "n_words", base.alias("base"), F.coalesce(near, F.array()).alias("matches"))
    verified = lambda m: reduce(lambda a, b: a | b, ((m.template == k) & reduce(lambda a, b: a | b, (F.contains(m.text, F.lit(f" {key} ")) for key in keys)) for k, (_, _, keys) in enumerate(templates)))
    found = found.withColumn("matches", F.filter("matches", verified))
    names = _literal([label for label, _, _ in templates])
    base_labels, n_base = F.array_sort(F.array_distinct("base.label")), F.size("base")
    sure = found.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("matches", lambda m: F.get(names, m.template))))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("matches.share"), F.lit(0.0)))).alias("score"),
    )
    nothing = F.lit(None).cast("long")
    rest = marked.where(F.col("words").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), nothing.alias("first_word"), nothing.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return sure.unionByName(rest)
