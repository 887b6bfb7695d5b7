"""Licence notices and texts: Dice coefficient over the word bigrams of normalised text.

Units are the lines of a text, its paragraphs, the whole text, and, so that the layout does
not matter, windows of as many words as a template has, at every place.  A unit is put in
lower case, with everything but letters and digits as a break, and compared with licence
templates by the Dice coefficient of the two sets of word bigrams,

    2 * shared / (bigrams of the unit + bigrams of the template)

As no more can be shared than the smaller set has, a template can only reach the
threshold t if the sizes satisfy  t / (2 - t) <= unit / template <= (2 - t) / t, and shares
t / (2 - t) of its bigrams at least.  So texts that do not hold that many bigrams of a
template are not looked at further, and units are compared with templates of fitting size
only; all bounds are in whole numbers.  The best template names a line, paragraph or text;
of windows that overlap by half the better one counts.  All of it happens in the row; text
is not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.tables import bind

#: The threshold in hundredths, so that bounds are whole numbers.
PERCENT = 80
#: Templates that a table of them may have at most.
MOST_TEMPLATES = 2_000
#: What joins two words of a bigram; normalised words do not hold it.
_JOIN = " "

# Notices and short licence texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        'other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. "
        "This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def template_bigrams(text: str) -> list[str]:
    found = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a}{_JOIN}{b}" for a, b in zip(found, found[1:])})


def template_length(text: str) -> int:
    """The number of word bigrams, repeats included."""
    return max(0, len(re.findall(r"[a-z0-9]+", text.lower())) - 1)


def size_bounds(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """The least and the greatest number of bigrams of a unit that can reach a template of `size` bigrams."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def least_shared(size: int, percent: int = PERCENT) -> int:
    """How many bigrams any unit that reaches a template of `size` bigrams shares with it."""
    return -(-percent * (size_bounds(size, percent)[0] + size) // 200)


def _bigrams(text: Column) -> Column:
    """The word bigrams of a text in order."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    most = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return bind(
        found,
        lambda w: F.zip_with(
            F.slice(w, 1, most(w)), F.slice(w, 2, most(w)), lambda a, b: F.concat(a, F.lit(_JOIN), b)
        ),
    )


def _list(values: Sequence[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    return F.array_distinct(F.concat(lines, F.split(whole, r"\n[\x20\t\r]*\n"), F.array(whole)))


def read_templates(table: DataFrame, name_col: str = "license", text_col: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates from a table of them, in the order of name and text; an error beyond MOST_TEMPLATES."""
    rows = table.select(name_col, text_col).dropna().distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple(sorted(map(tuple, rows)))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document and licence found: (id_col, license, similarity), the best of all units.

    Documents without a licence, null and empty texts give no row, and so do empty tables.
    Very long texts are read whole.  Rows that repeat an id count as one document; a null
    id is an id.  Of equally near templates the first counts.  Templates of a single word
    are never found.  Other columns of docs are ignored, whatever their names.
    """
    tables = [(name, template_bigrams(text), template_length(text)) for name, text in templates]
    tables = [(name, grams, length) for name, grams, length in tables if grams]
    needed = [least_shared(len(grams), percent) for _, grams, _ in tables]
    bounds = [size_bounds(len(grams), percent) for _, grams, _ in tables]
    low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
    every = _list(sorted({g for _, grams, _ in tables for g in grams}))
    nothing = F.lit(None).cast("struct<similarity:double,order:int,license:string>")

    def similarity(grams: Column, n: int | Column, template: Column) -> Column:
        shared = F.size(F.array_intersect(grams, template))
        return 2.0 * shared / (F.size(grams) + n)

    def reaches(x: Column) -> Column:
        # A similarity is a quotient of whole numbers and so the double nearest to it, as the threshold is.
        return x >= percent / 100

    def possible(held: Column) -> Column:
        """The numbers of the templates of which a text holds enough bigrams."""
        found = [
            F.when(F.size(F.array_intersect(held, _list(grams))) >= need, F.lit(n))
            for n, ((_, grams, _), need) in enumerate(zip(tables, needed, strict=True))
        ]
        return F.when(F.size(held) >= min(needed), F.array_compact(F.array(*found)))

    def named(grams: Column) -> Column:
        """The best template of a line, paragraph or text."""
        found = []
        for n, ((name, template, _), (least, most)) in enumerate(zip(tables, bounds, strict=True)):
            row = F.struct(
                similarity(grams, len(template), _list(template)).alias("similarity"),
                F.lit(-n).alias("order"),
                F.lit(name).alias("license"),
            )
            found.append(F.when(F.size(grams).between(least, most), row))
        return F.array_max(F.array(*found))

    def of_unit(unit: Column) -> Column:
        in_reach = lambda g: F.when(F.size(g).between(low, high), named(g)).otherwise(nothing)
        # A bigram takes three characters at least with its break, so short units have too few.
        return F.when(F.length(unit) >= 2 * low + 1, bind(F.array_distinct(_bigrams(unit)), in_reach)).otherwise(nothing)

    sets = F.array(*[_list(grams) for _, grams, _ in tables])
    sizes, lengths = (F.array(*[F.lit(x) for x in xs]) for xs in ([len(g) for _, g, _ in tables], [x for _, _, x in tables]))
    names = _list([name for name, _, _ in tables])

    def windows(grams: Column, n: Column) -> Column:
        """The windows as long as template n that begin with one of its bigrams and reach the threshold."""
        template, size, length = F.get(sets, n), F.get(sizes, n), F.get(lengths, n)
        starts = F.array_compact(F.transform(grams, lambda g, i: F.when(F.array_contains(template, g), i)))

        def hit(start: Column) -> Column:
            here = F.array_distinct(F.slice(grams, start + 1, length))
            return F.struct(
                start.alias("start"),
                (start + length).alias("end"),
                similarity(here, size, template).alias("similarity"),
                (-n).alias("order"),
                F.get(names, n).alias("license"),
            )

        return F.filter(F.transform(starts, hit), lambda h: reaches(h["similarity"]))

    reach = max(length for _, _, length in tables) * len(tables)

    def best(hits: Column) -> Column:
        """Windows that no better one of another licence overlaps by half; those are near in the order of starts."""

        def beaten(h: Column, k: Column) -> Column:
            near = F.slice(hits, F.greatest(k - reach + 1, F.lit(1)), F.lit(2 * reach))
            better = lambda o: (o["similarity"] > h["similarity"]) | (
                (o["similarity"] == h["similarity"]) & (o["order"] > h["order"])
            )
            shared = lambda o: F.least(o["end"], h["end"]) - F.greatest(o["start"], h["start"])
            return F.exists(
                near,
                lambda o: (o["license"] != h["license"]) & (2 * shared(o) >= h["end"] - h["start"]) & better(o),
            )

        return F.filter(hits, lambda h, k: ~beaten(h, k))

    def hits(text: Column, some: Column) -> Column:
        lines = F.filter(F.transform(units(text), of_unit), lambda x: reaches(x["similarity"]))
        placed = bind(_bigrams(text), lambda g: F.sort_array(F.flatten(F.transform(some, lambda n: windows(g, n)))))
        within = F.transform(
            bind(placed, best), lambda h: F.struct(*[h[c].alias(c) for c in ("similarity", "order", "license")])
        )
        return F.concat(lines, within)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    some = bind(F.array_intersect(_bigrams(F.col("text")), every), possible)
    # As an explode of one item, so that the filter does not compute the bigrams again.
    marked = rows.select("id", "text", F.explode(F.array(some)).alias("some")).where(F.size("some") > 0)
    return (
        marked.select("id", F.explode(hits(F.col("text"), F.col("some"))).alias("hit"))
        .groupBy(F.col("id").alias(id_col), F.col("hit.license").alias("license"))
        .agg(F.max("hit.similarity").alias("similarity"))
    )


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same for DuckDB: every unit with every template of which its text holds enough bigrams."""
    values = ", ".join(
        f"({i}, '{name}', {template_length(text)}, ['" + "', '".join(template_bigrams(text)) + "'])"
        for i, (name, text) in enumerate(templates)
    )
    split = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    need = f"(SELECT -CAST(floor(-({percent} * (-floor(-len(grams) * {percent}.0 / {200 - percent}) + len(grams)) / 200.0)) AS BIGINT))"
    dice = "2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams))"
    return f"""
WITH template(no, license, length, grams) AS (VALUES {values}),
doc AS (SELECT doc_id, text, {split.format('text')} AS w FROM documents WHERE text IS NOT NULL),
told AS (SELECT doc_id, text, {grams} AS g FROM doc),
holds AS (SELECT doc_id, text, g, no FROM told, template WHERE len(list_intersect(list_distinct(g), grams)) >= {need}),
unit AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
    string_split_regex(text, '\n[\x20\t\r]*\n'), [text])) AS u FROM holds),
word AS (SELECT doc_id, {split.format('u')} AS w FROM unit),
gram AS (SELECT doc_id, list_distinct({grams}) AS g FROM word WHERE len(w) >= 2),
named AS (
  SELECT doc_id, license, similarity FROM (
    SELECT doc_id, license, {dice} AS similarity, row_number() OVER (PARTITION BY doc_id, g ORDER BY {dice} DESC, no) AS nth
    FROM gram, template)
  WHERE nth = 1),
place AS (SELECT doc_id, g AS whole, no, unnest(range(1, len(g) + 1)) AS i FROM (SELECT DISTINCT doc_id, g, no FROM holds)),
win AS (
  SELECT doc_id, license, no, i AS start, i + length AS stop, {dice.replace('(g,', '(list_distinct(whole[i:i + length - 1]),').replace('len(g)', 'len(list_distinct(whole[i:i + length - 1]))')} AS similarity
  FROM place JOIN template USING (no) WHERE list_contains(grams, whole[i])),
hit AS (SELECT * FROM win WHERE similarity >= {percent / 100}),
best AS (
  SELECT doc_id, license, similarity FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.license <> h.license
    AND 2 * (least(o.stop, h.stop) - greatest(o.start, h.start)) >= h.stop - h.start
    AND (o.similarity > h.similarity OR o.similarity = h.similarity AND o.no < h.no)))
SELECT doc_id, license, max(similarity) AS similarity
FROM (SELECT * FROM named UNION ALL SELECT * FROM best)
WHERE similarity >= {percent / 100}
GROUP BY doc_id, license"""
