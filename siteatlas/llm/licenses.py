"""License texts in documents: MinHash bands over overlapping windows find templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are five words (a shorter text is one shingle).  A long template
(``LONG`` shingles or more) is looked up by windows of ``WINDOW`` shingles that start at every ``WINDOW / 2``-th shingle of a
document, against the template's windows at every offset.  So an unchanged copy holds windows that equal a template window
and collide for certain.  For windows with similarity s, ``BANDS`` bands of ``ROWS`` rows collide with probability
1 - (1 - s^ROWS)^BANDS: 0.983 at 0.8 for each window, and a copy has several.  A shorter template is looked up by windows of
a single shingle, whose only band is the shingle itself; containment of 0.8 implies one in common.

A retrieved template matches if the document holds at least 80 % of its distinct shingles.  Everything is row-local: no
shuffle.  The templates are literals, taken in slices of ``SLICE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.llm.common import identified

SHINGLE, WINDOW, LONG = 5, 8, 11
BANDS, ROWS = 4, 2
CONTAINED = 0.8
SLICE = 200

# License notices as they are published.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                "later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of each five words in a row; of all words where there are fewer."""
    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        return (F.when(F.size(h) >= SHINGLE, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])))
                .when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
                .otherwise(F.array().cast("array<long>")))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bands(shingles: Column, step: int) -> Column:
    """Band keys of all windows of ``WINDOW`` shingles that start at a multiple of ``step``.

    The minimum over ``step`` shingles is taken once and shared by the windows that overlap there.
    """
    parts = WINDOW // step
    seeds = range(BANDS * ROWS)

    def of(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(s) / step).cast("int") - 1)

        def least_of(seed: int) -> Column:
            return F.transform(blocks, lambda b: F.array_min(F.array(*[
                F.xxhash64(F.get(s, b * step + k), F.lit(seed)) for k in range(step)])))

        least = [least_of(j) for j in seeds]
        rows = F.struct(*[least[j].alias(f"m{j}") for j in seeds])

        def windows(m: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(m["m0"]) - parts)
            value = lambda i, j: F.least(*[F.get(m[f"m{j}"], i + p) for p in range(parts)]) if parts > 1 else F.get(m[f"m{j}"], i)
            return F.flatten(F.transform(starts, lambda i: F.array(*[
                F.xxhash64(F.lit(b), *[value(i, b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])))

        return F.when(F.size(s) >= WINDOW, _bound(rows, windows)).otherwise(F.array().cast("array<long>"))

    return _bound(shingles, of)


def template_index(spark: SparkSession, templates) -> list[dict]:
    """``license, shingles, keys, long`` of each template, computed by the same expressions as the documents'."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "n int, license string, text string")
    rows = rows.select("n", "license", F.array_distinct(_shingles(_words(F.col("text")))).alias("shingles"),
                       _bands(_shingles(_words(F.col("text"))), 1).alias("bands"))
    out = []
    for r in rows.orderBy("n").collect():
        long = len(r["shingles"]) >= LONG
        if r["shingles"]:
            out.append({"license": r["license"], "shingles": sorted(r["shingles"]), "long": long,
                        "keys": sorted(set(r["bands"] if long else r["shingles"]))})
    return out


def _among(hashes: Column, keys: list[int]) -> Column:
    """The distinct hashes that are keys."""
    return F.array_distinct(F.filter(hashes, lambda k: k.isin(keys))) if keys else F.array().cast("array<long>")


def _longs(values: list[int]) -> Column:
    return F.lit(values) if values else F.array().cast("array<long>")


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, n_words, matches`` of every row; ``matches`` are ``{template, license, n_found, n_shingles}``.

    ``template`` is the template's place in the list.  Null or empty text: no words, no match.  Texts under five words are one
    shingle.  Repeated rows and ids: a row each; null ids stay null.  Templates without words never match; equal ones
    match each.  Empty table: no rows.  Other columns are left alone.
    """
    index = template_index(docs.sparkSession, templates)
    rows = identified(docs).select("doc_id", _words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), _shingles(F.col("w")).alias("s"))
    kinds = {True: F.col("bands"), False: F.col("s")}
    rows = rows.withColumn("bands", _bands(F.col("s"), WINDOW // 2) if any(t["long"] for t in index) else F.array().cast("array<long>"))
    found = []
    for at in range(0, len(index), SLICE):
        some = index[at:at + SLICE]
        hits = {}
        for long in (True, False):
            keys = sorted({k for t in some if t["long"] == long for k in t["keys"]})
            hits[long] = _among(kinds[long], keys)

        def verified(h: Column, some=some, at=at) -> Column:
            def one(n: int, t: dict) -> Column:
                got = F.size(F.array_intersect(_longs(t["shingles"]), F.col("s")))
                match = F.struct(F.lit(at + n).alias("template"), F.lit(t["license"]).alias("license"), got.cast("long").alias("n_found"),
                                 F.lit(len(t["shingles"])).cast("long").alias("n_shingles"))
                near = F.arrays_overlap(h["long" if t["long"] else "short"], _longs(t["keys"]))
                return F.when(near & (got >= contained * len(t["shingles"])), match)

            none = F.array().cast("array<struct<template:int,license:string,n_found:bigint,n_shingles:bigint>>")
            any_hit = (F.size(h["long"]) > 0) | (F.size(h["short"]) > 0)
            return F.when(any_hit, F.filter(F.array(*[one(n, t) for n, t in enumerate(some)]), lambda m: m.isNotNull())).otherwise(none)

        found.append(_bound(F.struct(hits[True].alias("long"), hits[False].alias("short")), verified))
    matches = F.concat(*found) if found else F.array().cast("array<struct<template:int,license:string,n_found:bigint,n_shingles:bigint>>")
    return rows.select("doc_id", "n_words", matches.alias("matches"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"),
                          F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
                          F.array_join(F.transform("matches", lambda m: m["template"].cast("string")), ",").alias("templates"))
