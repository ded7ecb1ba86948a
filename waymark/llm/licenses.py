"""License scans by MinHash bands over text windows, in built-in functions only.

Texts and templates are lower-case words (runs of letters and digits) in runs of five.
Two windows are used. A template of at most SHORT words is found by windows of one run,
one word apart, whose MinHash is the run's hash. Longer templates are found by windows of
WINDOW runs: templates have one at each run, texts one every STRIDE runs. BANDS minima are
taken of each window, and one in common makes a template a candidate: windows of Jaccard
similarity s share one with a chance of 1 - (1 - s)**BANDS, 0.992 at 0.7, and a window
that lies in a verbatim template always does. A candidate is a match when the text holds at
least `least` of the template's different runs, compared as strings.

All steps are expressions over one row: nothing is shuffled. The templates are constants.

Rules: null and empty texts, and those of fewer than five words, have no license. Repeated
rows are scanned each. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import let, text_or_empty

RUN, SHORT, WINDOW, STRIDE, BANDS = 5, 24, 28, 8, 4
#: XOR masks that give each band an order of its own.
MASKS = (0, 0x5A3C96E1F00D7B42, -0x3B1E5D7C2A9F4E61, 0x12E4B7A95C3D8F06)

# Wording of common license notices.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def run_hashes(w: Column) -> Column:
    """Hashes of all runs; none of a text that is shorter than a run."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))
    return F.when(F.size(w) >= RUN, let(F.transform(w, lambda x: F.xxhash64(x)), runs)).otherwise(F.array().cast("array<long>"))


def run_strings(w: Column) -> Column:
    return F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.array_join(F.slice(w, i + 1, RUN), " "))).otherwise(F.array().cast("array<string>"))


def minima(h: Column, band: int, stride: int) -> Column:
    """Each window's minimum in a band. Windows start every stride runs; the last are short."""
    turned = F.transform(h, lambda x: x.bitwiseXOR(F.lit(MASKS[band]))) if band else h
    windows = lambda t: F.transform(F.sequence(F.lit(1), F.size(t), F.lit(stride)), lambda i: F.array_min(F.slice(t, i, WINDOW)))
    return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(let(turned, windows))


def compiled(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Hashes, band minima and runs of each template, by the expressions used on texts."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").withColumn("w", words(F.col("text"))).withColumn("h", run_hashes(F.col("w")))
    shape = rows.select("name", F.size("w").alias("n"), "h", F.array_distinct(run_strings(F.col("w"))).alias("runs"), *[minima(F.col("h"), b, 1).alias(f"b{b}") for b in range(BANDS)])
    return [r.asDict() for r in shape.collect()]


def constant(values: list[int]) -> Column:
    return F.lit(values) if values else F.array().cast("array<long>")


def matches(text: Column, table: list[dict], least: float) -> Column:
    """Array of (template, containment) of the licenses in a text, by template."""
    short, long = [t for t in table if t["n"] <= SHORT], [t for t in table if t["n"] > SHORT]
    fine = sorted({x for t in short for x in t["h"]})
    coarse = [sorted({x for t in long for x in t[f"b{b}"]}) for b in range(BANDS)]

    def retrieved(t: dict, h: Column, bands: list[Column]) -> Column:
        if t["n"] <= SHORT:
            return F.arrays_overlap(h, constant(t["h"]))
        found = [F.arrays_overlap(bands[b], constant(sorted(set(t[f"b{b}"])))) for b in range(BANDS)]
        return found[0] | found[1] | found[2] | found[3]

    def verified(w: Column, h: Column, m: Column) -> Column:
        bands = [F.get(m, b) for b in range(BANDS)]

        def each(runs: Column) -> Column:
            share = lambda t: F.size(F.array_intersect(runs, F.lit(t["runs"]))) / F.lit(float(len(t["runs"])))
            all_of = F.array(*[F.struct(F.lit(t["name"]).alias("template"), F.when(retrieved(t, h, bands), share(t)).otherwise(0.0).alias("containment")) for t in table])
            return F.filter(all_of, lambda x: x["containment"] >= least)

        return let(run_strings(w), each)

    def scan(w: Column, h: Column) -> Column:
        def judged(m: Column) -> Column:
            hit = F.arrays_overlap(h, constant(fine))
            for b in range(BANDS):
                hit = hit | F.arrays_overlap(F.get(m, b), constant(coarse[b]))
            return F.when(hit, verified(w, h, m)).otherwise(F.array().cast("array<struct<template:string,containment:double>>"))

        return let(F.array(*[minima(h, b, STRIDE) for b in range(BANDS)]), judged)

    return let(words(text), lambda w: let(run_hashes(w), lambda h: scan(w, h)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_licenses, licenses (template names, ascending, comma-joined),
    containments (of each, in that order)."""
    table = compiled(docs.sparkSession, TEMPLATES if templates is None else templates)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), matches(text_or_empty(), table, least).alias("found"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.col("found.template"), ",").alias("licenses"), F.col("found.containment").alias("containments"))
