"""License notices in texts: MinHash bands over windows, then exact containment.

Texts and templates become lower-case ASCII words and five-word shingles. A
window of a text meets a template if one of its band hashes, the smallest
shingle under one of many orders, is the template's too. Windows overlap so
that a passage as long as the template lies whole in one; their number of bands
follows from the least similarity such a window can have, so that it is missed
with a chance of at most MISS. What met is then checked shingle by shingle.
Everything is Spark's own expressions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import fence
from maskwright.llm.private import let

SHINGLE = 5
CONTAINED = 0.8
MISS = 0.001
#: Lengths in words up to which templates share their windows.
LENGTHS = (8, 16, 32, 64, 128, 256)
#: Words of fewer letters never serve to pass over texts.
LETTERS = 7

# The usual wording of notices, by license; several per license are allowed.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL", "This work is licensed under the GNU General Public License"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA", "Licensed under CC BY-SA"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC", "Licensed under CC BY-NC"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_shingles(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def triggers(templates: list[list[str]]) -> list[str]:
    """Words of which a text must have one to hold a template to 0.8.

    If none of a template's chosen words occurs, all shingles with one of them
    are missing; words are chosen, those of most use first, until these are
    more than a fifth.
    """
    chosen: list[str] = []

    def open_(words: list[str]) -> bool:
        shingles = template_shingles(words)
        return 5 * sum(not set(chosen).isdisjoint(s.split()) for s in shingles) <= len(shingles)

    while left := [w for w in templates if open_(w)]:
        long = sorted({x for w in left for x in w if len(x) >= LETTERS} - set(chosen)) or sorted({x for w in left for x in w} - set(chosen))
        chosen.append(max(long, key=lambda x: sum(x in w for w in left)))
    return chosen


def bands(size: int, templates: list[list[str]]) -> int:
    """How many smallest shingles a window of ``size`` words needs, for the worst of the templates."""
    least = 1.0
    for words in templates:
        own = len(template_shingles(words))
        held = math.ceil(CONTAINED * own)
        least = min(least, held / (size - SHINGLE + 1 + own - held))
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def shingled(words: Column) -> Column:
    """Distinct shingle hashes of an array of words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(every))


def band_hashes(shingles: Column, number: Column) -> Column:
    """The smallest shingle under each of ``number`` orders."""
    return F.transform(F.sequence(F.lit(0), number - 1), lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``key``, ``license``, ``containment``, ``word``: one row per text and license that it holds.

    ``containment`` is the share of the best template's shingles in its best
    window, ``word`` where that window begins, in words from 0. Null and empty
    texts hold none; a row repeated whole counts once; other columns are
    ignored; no rows give no rows. Templates need five words or more.
    """
    spark = docs.sparkSession
    split = [(name, template_words(body)) for name, body in templates]
    groups = [
        (high, own) for low, high in zip((0, *LENGTHS), LENGTHS, strict=False)
        if (own := [(name, words) for name, words in split if low < len(words) <= high])
    ]
    if sum(len(own) for _, own in groups) < len(split) or any(len(words) < SHINGLE for _, words in split):
        raise ValueError(f"templates need {SHINGLE} to {LENGTHS[-1]} words")
    sizes = [high + high // 2 for high, _ in groups]
    needed = [triggers([words for _, words in own]) for _, own in groups]
    numbers = F.array(*(F.lit(bands(size, [words for _, words in own])) for size, (_, own) in zip(sizes, groups, strict=True)))

    known = spark.createDataFrame(
        [(g, name, words) for g, (_, own) in enumerate(groups) for name, words in own], "group int, license string, words array<string>"
    ).select("group", "license", shingled(F.col("words")).alias("own"))
    # Of fixed size: the templates times their bands.
    wanted = known.select("*", F.posexplode(band_hashes(F.col("own"), F.get(numbers, F.col("group")))).alias("band", "least"))

    def windows(words: Column, g: int) -> Column:
        """The windows of one length that hold a word which its templates need."""
        some = F.array(*map(F.lit, needed[g]))
        every = F.transform(
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(groups[g][0] // 2)),
            lambda s: F.struct(F.lit(g).alias("group"), s.alias("word"), F.slice(words, s + 1, F.lit(sizes[g])).alias("w")),
        )
        held = F.filter(every, lambda p: F.arrays_overlap(p["w"], some))
        return F.when(F.arrays_overlap(words, some), held).otherwise(F.expr("cast(array() as array<struct<group:int,word:int,w:array<string>>>)"))

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), fence(F.lower(F.col(text))).alias("_lower"))
    plausible = rows.where(_any([F.col("_lower").contains(w) for w in sorted({w for own in needed for w in own})]))
    words = F.split(F.trim(F.regexp_replace("_lower", "[^a-z0-9]+", " ")), " ")
    parts = plausible.select("_key", "_text", fence(words).alias("w")).select(
        "_key", "_text", fence(F.concat(*(windows(F.col("w"), g) for g in range(len(groups))))).alias("windows")
    ).select("_key", "_text", F.explode("windows").alias("p"))
    hashed = parts.select("_key", "_text", "p.group", "p.word", fence(shingled(F.col("p.w"))).alias("shingles")).where(F.col("shingles").isNotNull())
    banded = hashed.select("*", F.posexplode(band_hashes(F.col("shingles"), F.get(numbers, F.col("group")))).alias("band", "least"))
    met = banded.join(F.broadcast(wanted), ["group", "band", "least"])
    held = F.size(F.array_intersect("shingles", "own")) / F.size("own")
    found = met.select("_key", "_text", "license", "word", held.alias("containment")).where(F.col("containment") >= CONTAINED)
    best = found.groupBy("_key", "_text", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("word"))).alias("b"))
    return best.select(F.col("_key").alias(key), "license", F.col("b.containment").alias("containment"), (-F.col("b.word")).alias("word"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
