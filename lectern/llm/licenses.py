"""License scans by the Dice coefficient over word bigrams, in DataFrame functions only.

Lines, paragraphs (lines between blank ones, where more than one) and whole texts are
normalised (lower case, runs of other than letters and digits become one space) and
compared with licence templates as sets of word bigrams: 2 |A and B| / (|A| + |B|). A
coefficient of t is out of reach unless |B| lies within [t / (2 - t), (2 - t) / t] of
|A|; only templates within those bounds are compared. Nor is it without one of the
template's telling words (see :func:`telling_words`), which is looked for first: units
without any are not cut into words. Rows never leave their task.

Within these units, sentences and windows of a template's number of words, laid where a
telling word would stand in it, are compared alike, with full licence texts besides. Of
them, units ``sentence`` and ``passage``, those are reported that no reported unit covers
by half, the largest template first; their position is the number of words before them.

Edge cases: null and empty texts, and units of fewer than two words, match nothing. Of
templates that tie the first by licence and template is reported. Repeated rows are
each reported. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let

DICE_AT = 0.8

#: Public licence notices and short licence texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


#: Licences whose full text is in license_texts, numbered after the templates.
FULL_TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "MPL-2.0")

#: Words that any prose has, the last choice as telling words.
COMMON = frozenset("a an and are as at be by for from in is it of on or other that the this to was with you".split())


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def full_texts() -> list[tuple[str, str]]:
    return [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in FULL_TEXTS]


def telling_words(grams: list[str], dice_at: float) -> list[str]:
    """Words of a template one of which any text has that reaches dice_at with it: rare and long ones first.

    Such a text shares at least dice_at / (2 - dice_at) of the template's bigrams, so it
    misses fewer than the bigrams in which these words stand.
    """
    missed = (1 - dice_at / (2 - dice_at)) * len(grams) + 1e-9
    chosen: set[str] = set()
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if sum(not chosen.isdisjoint(g.split()) for g in grams) > missed:
            break
        chosen.add(word)
    return sorted(chosen)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def units(text: Column, words: Column, telling: str, places: dict[str, list[tuple[int, int]]]) -> Column:
    """array<struct<unit, position, start, words>> of all units that have a telling word, and two words or more; start is the number of words before."""
    has = lambda x: F.lower(x).rlike(telling)
    sizes = lambda xs: F.transform(xs, lambda x: F.size(_words(x)))

    def numbered(xs: Column) -> Column:
        return let(sizes(xs), lambda n: F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.when(has(x), F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, k: a + k)).alias("start"))), lambda p: p["start"].isNotNull()))

    def entry(kind: str):
        position = lambda x: x["start"] if kind == "sentence" else x["i"]
        return lambda x: F.struct(F.lit(kind).alias("unit"), position(x).cast("long").alias("position"), x["start"].alias("start"), _words(x["x"]).alias("words"))

    multi = F.filter(numbered(F.split(text, r"\n[ \t-\r]*\n")), lambda p: F.contains(p["x"], F.lit("\n")))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(text)).otherwise(F.array().cast("array<string>"))
    at = F.from_json(F.lit(json.dumps(places)), "map<string, array<array<int>>>")
    anchors = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("i"), F.try_element_at(at, x).alias("p"))), lambda a: a["p"].isNotNull())
    spans = F.flatten(F.transform(anchors, lambda a: F.transform(a["p"], lambda q: F.struct(F.greatest(a["i"] - q[0], F.lit(0)).alias("start"), (F.least(a["i"] - q[0], F.lit(0)) + q[1]).alias("size")))))
    spans = F.array_distinct(F.filter(spans, lambda p: (p["size"] >= 2) & (3 * (F.size(words) - p["start"]) >= 2 * p["size"])))
    passages = F.transform(spans, lambda p: F.struct(F.lit("passage").alias("unit"), p["start"].cast("long").alias("position"), p["start"].alias("start"), F.slice(words, p["start"] + 1, p["size"]).alias("words")))
    sentences = F.transform(numbered(F.split(text, r"(?<=[.!?;:])\s+")), entry("sentence"))
    every = F.concat(F.transform(numbered(F.split(text, "\n")), entry("line")), F.transform(multi, entry("paragraph")), F.transform(numbered(whole), entry("text")), sentences, passages)
    return F.filter(every, lambda u: F.size(u["words"]) >= 2)


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """doc_id and value, computed once a row."""
    return rows.select("doc_id", F.inline(F.array(F.struct(value.alias(name)))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice_at: float = DICE_AT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, unit (line, paragraph, text, sentence or passage), position, license, template, n_bigrams, dice: the best template of each unit that reaches dice_at."""
    given = templates or [*TEMPLATES, *full_texts()]
    chosen = [(name, k, bigrams_of(t), re.sub(r"[^\w]+|_", " ", t.lower()).split()) for k, (name, t) in enumerate(given)]
    chosen = sorted((c for c in chosen if c[2]), key=lambda c: c[:2])
    low, high = dice_at / (2 - dice_at), (2 - dice_at) / dice_at
    places: dict[str, list[tuple[int, int]]] = {}
    for _, _, grams, words in chosen:
        for w in telling_words(grams, dice_at):
            places.setdefault(w, []).append((words.index(w), len(words)))
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(places))})(?![\p{{L}}\p{{N}}])"
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.lower("text").rlike(pattern))
    rows = own.select("doc_id", F.inline(F.array(F.struct("text", _words(F.col("text")).alias("w")))))
    rows = _once(rows, units(F.col("text"), F.col("w"), pattern, places), "us")
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    rows = _once(rows, F.transform("us", lambda u: F.struct(u["unit"], u["position"], u["start"], F.size(u["words"]).alias("size"), pairs(u["words"]).alias("b"))), "us")
    best = F.lit(None).cast("struct<dice:double,license:string,template:int,size:int>")

    def top(b: Column) -> Column:
        n, scored = F.size(b), []
        for name, k, grams, _ in chosen:
            fits = n.between(math.ceil(low * len(grams) - 1e-9), math.floor(high * len(grams) + 1e-9))
            dice = 2 * F.size(F.array_intersect(b, F.split(F.lit("|".join(grams)), r"\|"))) / (n + len(grams))
            scored.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("license"), F.lit(k).alias("template"), F.lit(len(grams)).alias("size"))).otherwise(best))
        return F.aggregate(F.array(*scored), best, lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a)) if scored else best

    hits = F.transform("us", lambda u: F.struct(u["unit"], u["position"], u["start"], u["size"], F.size(u["b"]).cast("long").alias("n_bigrams"), top(u["b"]).alias("t")))
    rows = _once(rows, F.filter(hits, lambda h: h["t"]["dice"] >= dice_at), "hits")
    within = lambda h: h["unit"].isin("sentence", "passage")
    order = lambda h: F.struct(-h["t"]["size"], -h["t"]["dice"], h["t"]["license"], h["t"]["template"], h["start"], h["size"], h["unit"])
    ranked = F.array_sort(F.transform(F.filter("hits", within), lambda h: F.struct(order(h).alias("o"), h.alias("h"))))
    shared = lambda x, y: F.least(x["start"] + x["size"], y["start"] + y["size"]) - F.greatest(x["start"], y["start"])
    told = F.aggregate(F.transform(ranked, lambda r: r["h"]), F.filter("hits", lambda h: ~within(h)), lambda a, x: F.when(F.exists(a, lambda y: 2 * shared(x, y) >= x["size"]), a).otherwise(F.concat(a, F.array(x))))
    out = rows.select("doc_id", F.explode(told).alias("h"))
    return out.select("doc_id", "h.unit", "h.position", "h.t.license", "h.t.template", "h.n_bigrams", "h.t.dice")
