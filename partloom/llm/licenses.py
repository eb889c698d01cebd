"""License scans: texts against licence templates by the Dice coefficient.

Texts and templates are normalised to lower-case words; each is the set of its word
bigrams. A text matches a template if twice the shared bigrams reach ``least`` of the
sum of both sizes. Two sets of very unlike size cannot reach it, so for each text only
the templates between two size bounds are compared at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.expressions import bind, neighbours, unused

LEAST = 0.8

# Licence templates (fixed values): identifier and text, whole or as the usual notice.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)

# A word of the normalised text: letters, digits, and single dots or hyphens inside.
NORMAL_WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
# The same words; no part gives back what it matched, so long runs do not nest.
_WORD = r"[\p{L}\p{N}]++(?:[.\-][\p{L}\p{N}]++)*+"


def normal_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    """The distinct word bigrams, each as a 64-bit hash."""
    pairs = neighbours(words, 1, lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def templates(spark: SparkSession, known: tuple[tuple[str, str], ...] = TEMPLATES) -> list:
    """Rows (name, number, grams) of the given templates, which are a short fixed list."""
    rows = spark.createDataFrame(
        [(name, i, text) for i, (name, text) in enumerate(known)], "name string, number int, text string"
    )
    return rows.select("name", "number", bigrams(normal_words(F.col("text"))).alias("grams")).collect()


def _scores(words: Column, known: list, least: float) -> Column:
    """Structs (score, name, number) of the templates that a unit's words match."""
    bounded = [
        (F.struct(F.lit(t["name"]).alias("name"), F.lit(t["number"]).alias("number"),
                  F.lit(len(t["grams"])).alias("size"),
                  F.array(*[F.lit(g) for g in t["grams"]]).alias("grams")))
        for t in known if t["grams"]
    ]
    low = min(len(t["grams"]) for t in known if t["grams"]) * least / (2 - least)
    high = max(len(t["grams"]) for t in known if t["grams"]) * (2 - least) / least

    def matches(grams: Column) -> Column:
        size = F.size(grams)
        near = F.filter(
            F.array(*bounded),
            lambda t: (t["size"] * least <= size * (2 - least))
            & (size * least <= t["size"] * (2 - least)),
        )
        scored = F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(t["grams"], grams)) / (t["size"] + size)).alias(
                    "score"
                ),
                t["name"].alias("name"),
                t["number"].alias("number"),
            ),
        )
        return F.filter(scored, lambda s: s["score"] >= least)

    # A repeated bigram only makes a set smaller, so few words bound the set from above.
    enough = F.size(words) - 1 >= low
    # A set within the bounds of the largest template may come from more words; those
    # are counted as a set first.
    return F.when(
        enough,
        bind(bigrams(words), lambda g: F.when(F.size(g) <= high, matches(g))),
    )


def license_matches(
    documents: DataFrame,
    least: float = LEAST,
    known: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """The columns of ``documents``, licenses, best_license, best_score, n_matches.

    Compared are each line, each block of lines between blank lines, and the whole text.
    licenses: the sorted names of all templates that any of these units matches with a
    Dice coefficient of ``least`` or more. best_*: the highest score, then the smallest
    name; null without a match. n_matches: matching pairs of a line and a template name.
    Null and empty texts match nothing. Every row is returned once for each time it
    comes; columns of these four names are replaced.
    """
    taken = ("licenses", "best_license", "best_score", "n_matches")
    rows = templates(documents.sparkSession, known)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, r"\n", -1)
    blocks = F.filter(F.split(text, r"\n[\x20\x09\r]*\n\s*", -1), lambda b: F.contains(b, F.lit("\n")))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(text)).otherwise(
        F.array().cast("array<string>")
    )

    def found(units: Column) -> Column:
        each = F.transform(units, lambda u: bind(normal_words(u), lambda w: _scores(w, rows, least)))
        return F.filter(each, lambda m: F.coalesce(F.size(m), F.lit(0)) > 0)

    names = [c for c in documents.columns if c not in taken]
    of_lines, of_blocks = unused(names, "_lines", "_blocks")
    marked = documents.select(
        *names,
        found(lines).alias(of_lines),
        F.flatten(found(F.array_distinct(F.concat(blocks, whole)))).alias(of_blocks),
    )
    every = F.concat(F.flatten(of_lines), F.col(of_blocks))
    best = F.array_max(
        F.transform(every, lambda m: F.struct(m["score"].alias("s"), (-m["number"]).alias("n"), m["name"].alias("name")))
    )
    per_line = F.transform(of_lines, lambda m: F.size(F.array_distinct(F.transform(m, lambda x: x["name"]))))
    return marked.select(
        *names,
        F.array_sort(F.array_distinct(F.transform(every, lambda m: m["name"]))).alias("licenses"),
        best["name"].alias("best_license"),
        F.round(best["s"], 6).alias("best_score"),
        F.aggregate(per_line, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_matches"),
    )
