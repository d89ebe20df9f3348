"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A text's words are its runs of letters and digits, A-Z lower-cased, so punctuation and quotes do not matter. Its
five-word shingles are hashed once, in order. Windows are runs of 1, 3 or 8 shingles at every position; a template is cut
the same way, into windows of the largest of these sizes that it holds. A window's signature is its least hash under each
of BANDS independent hash functions, one to a band, so windows with similarity s meet in some band with probability
``1 - (1 - s)^BANDS``: 1 for equal windows, 0.9993 at 0.6. (A window of one shingle has one band.) A passage that holds
0.75 of a template's shingles holds windows with two of three, or six of eight, of a window of the template; that is a
similarity of 0.5 or 0.6 at least, and a passage has many windows. Retrieved templates are then confirmed by the exact
share of their shingles in the passage around the window, as long as twice the template, at 0.75 or more. Templates that
share most of their wording are each reported with their own share.

Everything per row is a built-in expression. A window's least hash can equal a template's only if it belongs to one of
the template's shingles, so signatures are computed for windows that hold such a shingle; all others are known to meet no
band. There is no shuffle but the last grouping of hits. Templates are a table of any size: blocks of at most
TEMPLATE_WORDS words travel in the plan, one pass over the texts for each block.

Edge cases: null or blank texts and texts of fewer than five words hold no license; templates that are null or have fewer
than five words find nothing; repeated rows are scanned each, a repeated doc_id gives one row per license; columns other
than doc_id and text pass by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.words import SHINGLE_WORDS, ascii_lower, let, window_hashes

#: The public texts of licenses, and public wordings by which texts state theirs.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = "This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public License as published by the Free Software Foundation{after} either version {n} of the License, or (at your option) any later version."
_GNU_WARRANTY = (
    " This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {lesser}General Public License for more details."
    " You should have received a copy of the GNU {lesser}General Public License along with this {kind}"
)
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-2-Clause", _BSD_2 + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", (_GNU + _GNU_WARRANTY).format(kind="program", mark=";", lesser="", after=";", n="2")),
    ("GPL-3.0", (_GNU + _GNU_WARRANTY).format(kind="program", mark=":", lesser="", after=",", n="3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", (_GNU + _GNU_WARRANTY).format(kind="library", mark=";", lesser="Lesser ", after=";", n="2.1")),
    ("AGPL-3.0", _GNU.format(kind="program", mark=":", lesser="Affero ", after=",", n="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Words of templates that travel in one plan, at least one template.
TEMPLATE_WORDS = 20_000
CLASSES = (1, 3, 8)
BANDS = 8
THRESHOLD = 0.75


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles in order; empty for fewer than five words."""
    plain = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return window_hashes(F.split(plain, " "), SHINGLE_WORDS)


def band_key(shingles: Column, band: int) -> Column:
    """Least hash of a window's shingles under the band's own hash function."""
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def _bands(size: int) -> range:
    return range(1 if size == 1 else BANDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _blocks(templates: DataFrame | tuple[tuple[str, str], ...]) -> Iterator[list[tuple[str, str]]]:
    """Blocks of templates, a table read one partition after the other."""
    rows = templates if isinstance(templates, tuple) else ((r[0], r[1]) for r in templates.select("license", "text").toLocalIterator())
    block, words = [], 0
    for license_, text in rows:
        n = len((text or "").split())
        if block and words + n > TEMPLATE_WORDS:
            yield block
            block, words = [], 0
        if text:
            block.append((license_ or "", text))
            words += n
    if block:
        yield block


def scan(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document and license: doc_id, license, containment, first_word (of the best passage), n_passages.

    ``templates`` are pairs or a table of (license, text).
    """
    spark = docs.sparkSession
    sure = [s for s in (_scan(docs, spark, block) for block in _blocks(templates)) if s is not None]
    if not sure:
        return spark.sql("SELECT 0L AS doc_id, '' AS license, 0D AS containment, 0L AS first_word, 0L AS n_passages").limit(0)
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("w")))
    out = reduce(DataFrame.unionByName, sure).groupBy("doc_id", "license").agg(best.alias("b"), F.count_distinct("template", "first_word").alias("n_passages"))
    return out.select("doc_id", "license", F.round("b.containment", 6).alias("containment"), (-F.col("b.w")).alias("first_word"), "n_passages")


def _scan(docs: DataFrame, spark: SparkSession, block: list[tuple[str, str]]) -> DataFrame | None:
    """Confirmed passages: doc_id, license, template, at, containment, first_word."""
    texts = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in block)
    cut = spark.sql(f"SELECT * FROM VALUES {texts} AS t(license, text)").select("license", shingle_hashes(F.col("text")).alias("h"))
    hashes = [(r.license, r.h) for r in cut.collect() if r.h]
    if not hashes:
        return None
    rows = ", ".join(f"({t}, {_quoted(name)}, array({', '.join(map(_long, h))}), {len(h)})" for t, (name, h) in enumerate(hashes))
    shapes = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, shingles, m)")
    size = F.when(F.col("m") >= CLASSES[2], CLASSES[2]).when(F.col("m") >= CLASSES[1], CLASSES[1]).otherwise(CLASSES[0])
    windows = shapes.withColumn("size", size).select("template", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1), lambda i: F.slice("shingles", i, F.col("size")))).alias("w"))
    index = windows.select("template", "size", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), band_key(F.col("w"), b).alias("key")) for b in range(BANDS)])).alias("f")).select("template", "size", "f.*").distinct()
    used = sorted({max(s for s in CLASSES if s <= len(h)) for _, h in hashes})
    longest, widest = max(len(h) for _, h in hashes), max(CLASSES)
    # a window's least hash meets a template's only if its shingle is that template's: other windows cannot meet any
    # band and their signatures are not computed
    known = sorted({x for _, h in hashes for x in h})
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text")).alias("h")).filter(F.exists("h", lambda x: x.isin(known)))
    marks = F.filter(F.transform("h", lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(marks, lambda p: F.sequence(F.greatest(p - (widest - 1), F.lit(0)), p))))
    low = F.greatest(F.col("at") - longest, F.lit(0))
    near = held.select("doc_id", "h", F.explode(starts).alias("at")).select("doc_id", "at", low.alias("low"), F.slice("h", low + 1, 2 * longest + widest).alias("h"))

    def keys(size: int) -> list[Column]:
        start = F.col("at") - F.col("low")
        window = F.slice("h", start + 1, F.lit(size))
        return [F.struct(F.lit(size).alias("size"), F.lit(b).alias("band"), F.when(start + size <= F.size("h"), band_key(window, b)).alias("key")) for b in _bands(size)]

    found = near.select("doc_id", "at", "low", "h", F.explode(F.array(*[k for size in used for k in keys(size)])).alias("f")).select("doc_id", "at", "low", "h", "f.*")
    # the block bounds both tables: TEMPLATE_WORDS shingles, BANDS rows for each
    retrieved = found.join(F.broadcast(index), ["size", "band", "key"]).join(F.broadcast(shapes), "template")
    start = F.greatest(F.col("at") - F.col("m"), F.lit(0))
    passage = F.slice("h", start - F.col("low") + 1, 2 * F.col("m") + F.col("size"))
    first = let(F.col("shingles"), lambda s: start + F.array_position(F.transform(passage, lambda x: F.array_contains(s, x)), F.lit(True)) - 1)
    share = F.size(F.array_intersect("shingles", passage)) / F.size(F.array_distinct("shingles"))
    return retrieved.select("doc_id", "template", "license", "at", share.alias("containment"), first.cast("long").alias("first_word")).filter(F.col("containment") >= THRESHOLD)


def _long(x: int) -> str:
    return f"{x}L" if x != -(1 << 63) else "-9223372036854775807L - 1L"
