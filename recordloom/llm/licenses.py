"""License scans: overlapping windows of a text, MinHash bands, exact containment.

Templates are classed by length. A class cuts texts into windows of twice its
length that overlap by half, so any occurrence of a template lies whole in one of
them. One register a band, and as many bands as the least similar pair of window
and contained template needs, make a missed retrieval as rare as MISS. What is
retrieved is verified: a template matches where the window contains CONTAINED of
its shingles.

A window can only match if it has a shingle in common with a template; windows
without any of the words that all those shingles need are not hashed.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import column, whole_text
from recordloom.session import materialise

SHINGLE = 5  # words; all words of a shorter template
CONTAINED = 0.75
MISS = 1e-6
SHORTEST = 8  # most words of a template of the first class; each next class has four times as many

# Notices by which licenses are commonly declared.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the software without"
        " restriction.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(of: Column, width: int) -> Column:
    """Distinct 64-bit hashes of ``width`` words in a row."""
    places = F.sequence(F.lit(1), F.size(of) - (width - 1))
    hashed = F.transform(places, lambda at: F.xxhash64(F.array_join(F.slice(of, at, width), " ")))
    return F.when(F.size(of) >= width, F.array_distinct(hashed)).otherwise(
        F.array().cast("array<bigint>")
    )


def minima(of: Column, bands: int) -> Column:
    """The smallest of the hashes under each of ``bands`` further hash functions."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)),
        lambda band: F.array_min(F.transform(of, lambda x: F.xxhash64(x, band))),
    )


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def length_class(words: int) -> int:
    """The most words of a template of the class that ``words`` words belong to."""
    most = SHORTEST
    while most < words:
        most *= 4
    return most


def bands_needed(sizes: Sequence[int], window: int, width: int) -> int:
    """Bands for which every template of so many shingles, contained in a full
    window of other shingles, is retrieved but for a chance of MISS."""
    most = window - width + 1
    likeness = min(
        math.ceil(CONTAINED * n) / (most + n - math.ceil(CONTAINED * n)) for n in sizes
    )
    return math.ceil(math.log(MISS) / math.log(1 - likeness)) if likeness < 1 else 1


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    id_name: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and license found: doc_id, license, containment (the
    best of its windows), windows (how many match), first_word (where the first
    of them starts).

    A null or empty text has none. Documents that share an id, or have none, are
    reported together. Other columns are not read. The templates are parameters of
    the job, a few hundred texts at most, and so are the tables derived from them
    that are broadcast.
    """
    spark = docs.sparkSession
    classes: dict[tuple[int, int], list[tuple[str, str]]] = defaultdict(list)
    telling: dict[tuple[int, int], set[str]] = defaultdict(set)
    sizes: dict[tuple[int, int], list[int]] = defaultdict(list)
    for name, body in templates:
        parts = _plain_words(body)
        if not parts:
            continue
        width = min(SHINGLE, len(parts))
        key = (length_class(len(parts)), width)
        every = {tuple(parts[at : at + width]) for at in range(len(parts) - width + 1)}
        classes[key].append((name, body))
        sizes[key].append(len(every))
        # A shingle is there only if its longest word is.
        telling[key] |= {max(shingle, key=lambda w: (len(w), w)) for shingle in every}

    def any_of(of: Column, known: set[str]) -> Column:
        return F.arrays_overlap(of, F.array(*[F.lit(w) for w in sorted(known)]))

    split = docs.select(column(id_name).alias("doc_id"), words(whole_text(text)).alias("words"))
    # Few texts pass; their words are stored once for all classes.
    hinted = materialise(
        split.filter(any_of(F.col("words"), set().union(*telling.values()))), "license-hints"
    )
    found = None
    for key, members in sorted(classes.items()):
        length, width = key
        bands = bands_needed(sizes[key], 2 * length, width)
        listed = json.dumps([{"license": n, "body": b} for n, b in members])
        known = (
            spark.range(1)
            .select(F.inline(F.from_json(F.lit(listed), "array<struct<license:string,body:string>>")))
            .withColumn("parts", shingles(words(F.col("body")), width))
        )
        retrieved = known.select(
            "license", "parts", F.posexplode(minima(F.col("parts"), bands)).alias("band", "value")
        )
        n = F.size("words")
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(length)),
            lambda at: (at == 0) | (at + length < n),  # else it lies in the one before
        )
        windows = (
            hinted.select("doc_id", "words", F.explode(starts).alias("start"))
            .select(
                "doc_id", "start",
                F.slice("words", F.col("start") + 1, 2 * length).alias("window"),
            )
            .filter(any_of(F.col("window"), telling[key]))
            .select("doc_id", "start", shingles(F.col("window"), width).alias("own"))
        )
        matches = (
            windows.select(
                "doc_id", "start", "own",
                F.posexplode(minima(F.col("own"), bands)).alias("band", "value"),
            )
            .join(F.broadcast(retrieved), ["band", "value"])
            .select(
                "doc_id", "license", "start", F.lit(length).alias("length"),
                (F.size(F.array_intersect("own", "parts")) / F.size("parts")).alias("share"),
            )
            .filter(F.col("share") >= CONTAINED)
        )
        found = matches if found is None else found.unionByName(matches)
    if found is None:
        found = split.select(
            "doc_id", F.lit("").alias("license"), F.lit(0).alias("start"),
            F.lit(0).alias("length"), F.lit(0.0).alias("share"),
        ).filter("false")
    return found.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"),
        F.count_distinct("start", "length").alias("windows"),
        F.min("start").cast("bigint").alias("first_word"),
    )
