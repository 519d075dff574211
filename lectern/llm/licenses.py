"""License scans, by DataFrame functions alone.

Texts are cut into overlapping windows of words, at three sizes, as notices of one
line and whole headers need windows of their own order of length. MinHash bands
of a window's five-word shingles retrieve templates; what is retrieved is then
verified by exact containment of the template's shingles in the words around.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import col

#: Words of a shingle, and share of a template's shingles that a text must contain in one place.
SHINGLE, CONTAINMENT = 5, 0.8
#: (words of a window, words between starts, and of a template's piece): starts are half a window apart, so any run of half a window's words is whole in some window.
SIZES = ((10, 5), (24, 12), (64, 32))
#: Bands of one MinHash each. One shared value retrieves; see miss_chance.
BANDS = 48

# Public notices and headers of common licenses (for the long ones, their best known sentences).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _count(n: Column, step: int, body) -> Column:
    """body of 0, step, 2 step ... below n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), body)).otherwise(F.array())


def shingles(of: Column) -> Column:
    """All runs of SHINGLE words; of fewer words, the run of them all."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(of) - SHINGLE + 1)), lambda i: F.array_join(F.slice(of, i, F.lit(SHINGLE)), " "))


def bands(of: Column) -> Column:
    """(band, value): for each band, the smallest of the shingles' hashes, each hashed again with that band's number."""
    numbers = F.array(*(F.lit(k) for k in range(BANDS)))
    hashes = F.transform(shingles(of), lambda s: F.xxhash64(s))
    return F.transform(F.array(hashes), lambda h: F.transform(numbers, lambda k: F.struct(k.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(k, x))).alias("value"))))[0]


def miss_chance(piece_words: int, size: int) -> float:
    """Chance that a window that holds as much of a template's piece as it must shares no band with it."""
    mine = max(1, piece_words - SHINGLE + 1)
    there = size - SHINGLE + 1
    shared = min(math.ceil(CONTAINMENT * mine), there)
    return (1 - shared / (mine + there - shared)) ** BANDS


def _pieces(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """license, template (its number), whole (its words), size and piece: the words that one window is to hold."""
    flat = [(name, t) for name, ts in sorted(templates.items()) for t in ts]
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), F.lit(t).alias("t")) for k, (name, t) in enumerate(flat))))
    whole = spark.range(1).select(rows.alias("r")).select("r.license", "r.template", words(F.col("r.t")).alias("whole"))
    n = F.size("whole")

    def cut(size: int, step: int) -> Column:  # pieces of step words, the last one flush with the end
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / step).cast("int") - 1))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), F.slice("whole", F.greatest(F.lit(1), F.least(i * step + 1, n - step + 1)), F.lit(step)).alias("piece")))

    # The largest pieces that fit into the template.
    cuts = F.when(n < SIZES[1][1], cut(*SIZES[0])).when(n < SIZES[2][1], cut(*SIZES[1])).otherwise(cut(*SIZES[2]))
    return whole.select("license", "template", "whole", F.explode(cuts).alias("c")).select("license", "template", "whole", "c.size", "c.piece")


def anchors(templates: dict[str, list[str]]) -> list[str]:
    """Words such that 0.8 of any template's shingles can't be had without one of them: enough of each template's words, longest first, to touch over a fifth of its shingles."""
    import re

    out: set[str] = set()
    for t in (t for ts in templates.values() for t in ts):
        w = re.findall("[a-z0-9]+", t.lower())
        runs = [{*w[i : i + SHINGLE]} for i in range(max(1, len(w) - SHINGLE + 1))]
        for word in sorted({*w}, key=lambda x: (x not in out, not x.startswith("licens"), -len(x), x)):
            if sum(bool(r & out) for r in runs) > (1 - CONTAINMENT) * len(runs) + 1e-9:
                break
            out.add(word)
    return sorted(out)


def scan(df: DataFrame, *, row: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """row, license, containment (of its best template, 4 decimals) and first_word (where that begins) of every license found.

    Whole texts are scanned; a text without a license has no row. Null and empty
    texts hold none. Rows with one id, or without, are scanned apart and the best
    of them reported once; other columns are ignored. Before any window is cut,
    texts are dropped that hold none of the anchors, without which no template
    can be contained. The templates, a fixed list, are all that is broadcast.
    """
    templates = TEMPLATES if templates is None else templates
    pieces = _pieces(df.sparkSession, templates)
    longest = max((len(t.split()) * 2 for ts in templates.values() for t in ts), default=1)
    wanted = r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors(templates)) + r")(?![a-z0-9])"
    held = df.where(col(text).rlike(wanted)).select(col(row).alias("row"), words(col(text)).alias("words"))
    n = F.size("words")
    starts = lambda size, step: _count(F.greatest(F.lit(1), n - step), step, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at")))
    cut = F.concat(*(starts(*s) for s in SIZES))
    windows = held.select("row", "words", F.explode(cut).alias("w")).select(
        "row", F.col("w.size").alias("size"), F.slice("words", F.col("w.at") + 1, F.col("w.size")).alias("window"),
        F.greatest(F.lit(0), F.col("w.at") - longest).alias("near_at"), F.slice("words", F.greatest(F.lit(0), F.col("w.at") - longest) + 1, F.lit(2 * longest + SIZES[-1][0])).alias("near"),
    )
    mine = windows.where(F.size("window") > 0).select("row", "size", "near_at", "near", F.explode(bands(F.col("window"))).alias("b")).select("row", "size", "near_at", "near", "b.band", "b.value")
    theirs = pieces.select("license", "template", "whole", "size", F.explode(bands(F.col("piece"))).alias("b")).select("license", "template", "whole", "size", "b.band", "b.value").distinct()
    # One shared value is a candidate; a candidate that several bands give is verified for the first of them only.
    found = mine.join(F.broadcast(theirs), ["size", "band", "value"]).groupBy("row", "license", "template", "whole", "near_at", "near").agg(F.lit(1)).drop("1")
    wants, has = F.array_distinct(shingles(F.col("whole"))), shingles(F.col("near"))
    checked = found.select("row", "license", "near_at", wants.alias("wants"), has.alias("has"))
    both = F.array_intersect("has", "wants")
    first = F.array_min(F.transform(both, lambda s: F.array_position("has", s))).cast("int") - 1 + F.col("near_at")
    exact = checked.select("row", "license", (F.size(both) / F.size("wants")).alias("containment"), first.alias("first_word")).where(F.col("containment") >= CONTAINMENT)
    best = F.min(F.struct(-F.col("containment"), F.col("first_word")))
    return exact.groupBy("row", "license").agg(best.alias("b")).select("row", "license", F.round(-F.col("b.col1"), 4).alias("containment"), F.col("b.first_word"))
