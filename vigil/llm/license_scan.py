"""License scans by MinHash bands over overlapping windows, in DataFrame functions alone.

Texts and templates are lower-cased and cut into runs of letters and digits; a shingle is five of these. A template of m
shingles belongs to a window size that covers it wherever it starts: windows of c shingles start at every c/8-th place
(every place for small c), so one of them holds all of it; sizes grow by a seventh or so, without end, so that c is at
most 1.32 m. Windows get a MinHash signature of ``BANDS`` bands of ``ROWS`` values, and a band equal to one of a template
of the window's size retrieves that template. A window around four fifths of a template has a Jaccard similarity to it of
0.52 at least, where 24 bands of 2 miss with a probability of 0.73^24 < 0.1 %. What is retrieved is verified by the exact
share of the template's shingles in the window, which must be ``CONTAINMENT``.

Two exact filters keep this off the great mass of text: a document must hold a key word (the driver picks words such
that a text with enough of a template has one), and a window must hold a template shingle; without one the containment
is 0.

Defined results: a null or empty text has no match; a document's repeated matches of a template give its best one (the
first of equal ones); rows with the same id are reported as one; extra columns are left out; an empty table gives an
empty result. Templates need five words at least.

Scale: the templates are a list of bounded size (``MAX_SHINGLES``, checked) which is part of the plan and is broadcast
for the band join. The scan is narrow; only matches are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 24, 2
MAX_SHINGLES, MAX_KEYS = 20_000, 100

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_DISCLAIMED = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    f"{_BSD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_NO_WARRANTY = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
#: Usual notices, headers and whole texts of public licences. Longer ones can be passed to ``scan``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "AGPL-3.0 header": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_NO_WARRANTY} See the GNU Affero General Public License for more details.",
    "BSD": _BSD,
    "BSD-2-Clause": f"{_BSD_TWO} {_DISCLAIMED}",
    "BSD-3-Clause": f"{_BSD_TWO} {_BSD_NAMES} {_DISCLAIMED}",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 header": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_NO_WARRANTY} See the GNU General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library {_NO_WARRANTY} See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Licensed under the MIT License.",
    "MIT header": _MIT,
    "MIT text": f'{_MIT} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_shingles(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    if len(words) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def stride(size: int) -> int:
    return max(1, size // 8)


def window_size(n: int) -> int:
    """The least size of which one window holds any n neighbouring shingles."""
    size = 1
    while size - stride(size) + 1 < n:
        size = max(size + 1, size * 23 // 20)
    return size


def key_words(templates: dict[str, str]) -> list[list[str]]:
    """Sets of words such that a text with ``CONTAINMENT`` of a template's shingles holds all words of some set: for each
    template long words that more of its shingles have than may be missing, or else all words of so many shingles."""
    out: list[list[str]] = []
    for text in templates.values():
        left = template_shingles(text)
        need = int((1 - CONTAINMENT) * len(left) + 1e-9) + 1
        for known in out:
            covered = [s for s in left if set(known) <= set(s.split())]
            need -= len(covered)
            left = [s for s in left if s not in covered]
        while need > 0:
            count = Counter(w for s in left for w in set(s.split()) if len(w) >= 5)
            words = [max(count, key=lambda w: (min(count[w], need) * min(len(w) - 3, 5), w))] if count else sorted(set(left[0].split()))
            covered = {s for s in left if set(words) <= set(s.split())}
            out.append(words)
            need -= len(covered)
            left = [s for s in left if s not in covered]
    return out


def signature(shingles: Column) -> Column:
    """For each band a hash of the least values of its hash functions over the shingles."""

    def least_of(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(k), s)))

    least = [least_of(k) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _windows(places: Column, size: int) -> Column:
    """The windows (size, start) that hold one of the places."""
    step = stride(size)

    def first_to_last(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((p - size) / step) + 1).cast("int"), F.floor(p / step).cast("int"))

    numbers = F.array_distinct(F.flatten(F.transform(places, first_to_last)))
    return F.transform(numbers, lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start")))


def _template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(name, own := template_shingles(text), window_size(len(own))) for name, text in sorted(templates.items())]
    total = sum(len(r[1]) for r in rows)
    if total > MAX_SHINGLES:
        raise ValueError(f"the templates have {total} shingles; at most {MAX_SHINGLES} are broadcast")
    listed = F.array(*[F.struct(F.lit(n).alias("template"), F.array(*map(F.lit, s)).alias("ts"), F.lit(c).alias("size")) for n, s, c in rows])
    return spark.range(1).select(F.inline(listed))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, containment, word_start, n_words): each template found in each document and where it is best held;
    word_start counts the document's runs of letters and digits from 0."""
    templates = TEMPLATES if templates is None else templates
    table = _template_table(docs.sparkSession, templates)
    every = sorted({s for t in templates.values() for s in template_shingles(t)})
    sizes = sorted({window_size(len(template_shingles(t))) for t in templates.values()})
    lower = F.lower(F.col(f"`{text_col}`"))
    keys = key_words(templates)
    # looking for very many key words costs more than cutting all texts into shingles
    holds = reduce(or_, [reduce(and_, [F.contains(lower, F.lit(w)) for w in words]) for words in keys]) if len(keys) <= MAX_KEYS else F.lit(True)
    df = docs.filter(holds).select(F.col(f"`{id_col}`").alias(id_col), F.split(F.btrim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), " ", -1).alias("w"))
    w, g = F.col("w"), F.col("g")
    # neighbours by zipping the words with themselves: no lambda refers to another column, so that a filter that is
    # pushed below repeats this once a text and not once a word
    n = F.greatest(F.size(w) - SHINGLE + 1, F.lit(0))
    five = F.transform(F.arrays_zip(*[F.slice(w, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)]), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(SHINGLE)]))
    df = df.select(id_col, five.alias("g"))
    places = F.filter(F.transform(g, lambda x, i: F.when(x.isin(every), i)), lambda p: p.isNotNull())
    df = df.select(id_col, "g", places.alias("places")).filter(F.size("places") > 0)
    df = df.select(id_col, "g", F.explode(F.concat(*[_windows(F.col("places"), c) for c in sizes])).alias("x"))
    df = df.select(id_col, F.col("x.size").alias("size"), F.col("x.start").alias("start"), F.array_distinct(F.slice(g, F.col("x.start") + 1, F.col("x.size"))).alias("s"))
    df = df.select("*", F.posexplode(signature(F.col("s"))).alias("band", "key"))
    bands = table.select("template", "ts", "size", F.posexplode(signature(F.col("ts"))).alias("band", "key"))
    found = df.join(F.broadcast(bands), ["size", "band", "key"])
    share = F.size(F.array_intersect("s", "ts")) / F.size("ts")
    found = found.withColumn("share", share).filter(F.col("share") >= CONTAINMENT)
    best = F.max(F.struct("share", (-F.col("start")).alias("start"), (F.col("size") + SHINGLE - 1).alias("n"))).alias("b")
    out = found.groupBy(id_col, "template").agg(best)
    return out.select(id_col, "template", F.round("b.share", 6).alias("containment"), (-F.col("b.start")).cast("long").alias("word_start"), F.col("b.n").cast("long").alias("n_words"))
