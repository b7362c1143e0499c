"""License scan: MinHash bands over overlapping windows, then exact containment; DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. A template of ``n`` words is
looked for in windows of ``2.25 n`` words that start every ``n / 4`` words, so that every stretch of ``2 n``
words lies whole in a window: a copy may be stretched to twice its length by insertions, wherever it
starts. A window matches if it holds at least 0.8 of the template's distinct shingles. Such a window has a
Jaccard similarity of at least ``0.8 t / (w + 0.2 t)`` (``t`` and ``w``: shingles of template and window),
and the number of bands is the smallest that finds that similarity with a probability of ``FOUND`` or
more. Every window that shares a band with a template is verified by exact containment, so nothing is
reported by chance.

Filters that lose nothing come first. A match lacks at most 0.2 of the template's shingles, so it
holds a shingle with one of a few anchor words (the longest words whose shingles are more than that
share): texts without any anchor are passed over. Of a window only the shingles that some template has
are hashed, which can only raise its similarity to a template. Templates are a stated, short list of at most ``MOST_TEMPLATES``, and are broadcast.

Defined results: null and empty texts, and texts of fewer than five words, match nothing; a template that
stands in several windows is reported once per id, at the best window, the first of equals; rows that
repeat an id are read as one document; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8
#: Hashes in a band, and the probability of finding a window at the threshold.
ROWS, FOUND = 1, 0.9995
MOST_TEMPLATES = 1_000

# Public license statements and notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def once(value: Column) -> Column:
    """The value as a generated column: it is computed once a row, not wherever a lambda names it."""
    return F.explode(F.array(value))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(tokens: Column) -> Column:
    """Hash of the five words from every position on."""
    count = F.size(tokens) - (SHINGLE - 1)
    hashed = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, SHINGLE), " ")),
    )
    return F.when(count > 0, hashed).otherwise(F.array().cast("array<long>"))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every match holds at least one: the longest, until their shingles are enough."""
    out: set[str] = set()
    for text in templates.values():
        tokens = template_words(text)
        grams = {tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1)}
        may_lack = math.floor(len(grams) - math.ceil(CONTAINED * len(grams) - 1e-9))
        covered: set[tuple[str, ...]] = set()
        for word in sorted(set(tokens), key=lambda w: (-len(w), w)):
            if len(covered) > may_lack:
                break
            out.add(word)
            covered |= {g for g in grams if word in g}
    return sorted(out)


def window(n: int) -> tuple[int, int]:
    """Length and stride of the windows for a template of ``n`` words."""
    stride = max(1, n // 4)
    return 2 * n + stride, stride


def bands(n: int) -> int:
    """Bands that find a matching window of a template of ``n`` words."""
    t, w = n - SHINGLE + 1, window(n)[0] - SHINGLE + 1
    similarity = CONTAINED * t / (w + (1 - CONTAINED) * t)
    return math.ceil(math.log(1 - FOUND) / math.log(1 - similarity**ROWS))


def _signature(grams: Column, count: Column) -> Column:
    """(band, key) of a set of shingles."""

    def lowest(k: Column) -> Column:
        return F.array_min(F.transform(grams, lambda x: F.xxhash64(x, k)))

    def key(j: Column) -> Column:
        parts = [lowest(j * ROWS + r) for r in range(ROWS)]
        return F.struct(j.alias("band"), F.xxhash64(*parts).alias("key"))

    return F.transform(F.sequence(F.lit(0), count - 1), key)


def _windows(n: int) -> Column:
    """(n, bands, at, grams) of the windows for templates of ``n`` words that hold one of the ``hits``;
    ``g`` is null where no template has the shingle."""
    length, stride = window(n)
    inside = length - SHINGLE  # the last shingle of a window starts here

    def around(p: Column) -> Column:
        first = F.greatest(F.ceil((p - inside) / stride), F.lit(0))
        return F.sequence(first.cast("int"), F.floor(p / stride).cast("int"))

    def cut(k: Column) -> Column:
        at = k * stride
        grams = F.array_distinct(F.array_compact(F.slice(F.col("g"), at + 1, inside + 1)))
        return F.struct(F.lit(n).alias("n"), F.lit(bands(n)).alias("bands"), at.alias("at"), grams.alias("grams"))

    return F.transform(F.array_distinct(F.flatten(F.transform("hits", around))), cut)


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    tokens = {name: template_words(text) for name, text in templates.items()}
    rows = [(name, " ".join(w), len(w), bands(len(w)) if len(w) >= SHINGLE else 0) for name, w in tokens.items()]
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if any(n < SHINGLE for _, _, n, _ in rows):
        raise ValueError(f"a template needs at least {SHINGLE} words")
    table = spark.createDataFrame(rows, "template string, text string, n int, bands int")
    return table.withColumn("wanted", F.array_distinct(shingles(F.split("text", " ")))).drop("text")


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per id and template found: doc_id, template, first_word (from 0), containment."""
    spark = docs.sparkSession
    known = _template_rows(spark, templates)
    lengths = sorted({len(template_words(t)) for t in templates.values()})
    # the hashes of a short, bounded list; taken to the driver they become a constant set in the plan
    wanted = sorted({h for r in known.select("wanted").collect() for h in r["wanted"]})

    text = F.col(f"`{text_col}`")
    low = F.lower(text)
    has_anchor = F.lit(False)
    for word in anchors(templates):
        has_anchor = has_anchor | F.contains(low, F.lit(word))
    tokens = docs.filter(has_anchor).select(F.col(f"`{id_col}`").alias("doc_id"), once(words(text)).alias("tokens"))
    grams = tokens.select("doc_id", once(shingles(F.col("tokens"))).alias("g"))
    grams = grams.select("doc_id", once(F.transform("g", lambda x: F.when(x.isin(wanted), x))).alias("g"))
    places = F.array_compact(F.transform("g", lambda x, i: F.when(x.isNotNull(), i)))
    hits = grams.select("doc_id", "g", once(places).alias("hits")).filter(F.size("hits") > 0)
    every = F.concat(*[_windows(n) for n in lengths])
    windows = hits.select("doc_id", F.explode(every).alias("w")).select("doc_id", "w.*")
    count = F.col("bands")
    probes = windows.select("doc_id", "n", "at", "grams", F.explode(_signature(F.col("grams"), count)).alias("s"))
    probes = probes.select("doc_id", "n", "at", "grams", "s.band", "s.key")
    index = known.select("n", "template", F.explode(_signature(F.col("wanted"), count)).alias("s"))
    index = index.groupBy("n", "s.band", "s.key").agg(F.collect_set("template").alias("templates"))
    near = probes.join(F.broadcast(index), ["n", "band", "key"])
    near = near.select("doc_id", "at", "grams", F.explode("templates").alias("template"))
    common = F.size(F.array_intersect("grams", "wanted")) / F.size("wanted")
    results = (
        near.join(F.broadcast(known.select("template", "wanted")), "template")
        .select("doc_id", "template", "at", common.alias("containment"))
        .filter(F.col("containment") >= CONTAINED)
    )
    # the best window, the first of equals
    best = F.max(F.struct("containment", (-F.col("at")).alias("before")))
    return (
        results.groupBy("doc_id", "template")
        .agg(best.alias("b"))
        .select("doc_id", "template", (-F.col("b.before")).cast("long").alias("first_word"), F.col("b.containment").alias("containment"))
    )
