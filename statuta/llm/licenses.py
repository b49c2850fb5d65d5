"""Operator 5: licence scans.

Header lines and licence files are compared with templates by the cosine of sparse TF-IDF
vectors; a file without a licence of its own takes that of its nearest ancestor directory
which holds a licence file, found by joins on path prefixes.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_broadcast, free_name, staged

THRESHOLD = 0.6
#: By so much a bound may miss the threshold, for rounding.
SLACK = 1e-6

# Short notices by which these licences are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution 4.0 International, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WARRANTY = "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    f"{_WARRANTY} AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE '
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
    "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str, kind: str = "program") -> str:
    """The header by which the GNU licences are applied to a file."""
    return (
        f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or "
        f"(at your option) any later version. This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
        f"A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {kind}. If not, see <https://www.gnu.org/licenses/>."
    )


def _creative(name: str, code: str) -> tuple[str, ...]:
    """The notice, title and short form of a Creative Commons licence."""
    return (f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Creative Commons {name} 4.0 International Public License", f"Licensed under the Creative Commons {name} licence ({code} 4.0), https://creativecommons.org/licenses/{code.split()[-1].lower()}/4.0/")


#: Header blocks, titles of licence files and bodies, several a licence.
BLOCKS = {
    "0BSD": (_ISC + _ISC_END,),
    "AGPL-3.0": (_gnu("GNU Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "Artistic-2.0": ("The Artistic License 2.0 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)"),
    "BSD-2-Clause": (_BSD_START + _BSD_END,),
    "BSD-3-Clause": (_BSD_START + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so",
    ),
    "CC-BY-4.0": _creative("Attribution", "CC BY"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-ND-4.0": _creative("Attribution-NoDerivatives", "CC BY-ND"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "CC BY-SA"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
    ),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL", "EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL"),
    "GPL-2.0": (_gnu("GNU General Public License", "2").replace("software: you", "software; you"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
        _gnu("GNU General Public License", "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies" + _ISC_END,),
    "LGPL-2.1": (_gnu("GNU Lesser General Public License", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": (_gnu("GNU Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        f'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING {_WARRANTY}, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT '
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain.",
    ),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution.",
    ),
}
#: A line that names its licence by identifier.
SPDX = r"(?i)spdx-license-identifier:\s*([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Lines in a block; blocks overlap by three quarters, and the whole text is one too.
BLOCK_LINES = (1, 2, 3, 5, 8, 13, 21, 34, 55)
#: A document whose first or last line has one of these stands for a licence file; names that are common
#: words or letters otherwise count in capitals. Lines are compared whether they have one or not.
ANCHOR = r"(?i:licen[sc]|apache|\bgnu\b|mozilla|creative commons)|\b(?:MIT|BSD|CC)\b"
_TOKEN = r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"


def _idf() -> dict[str, float]:
    docs = [set(re.findall(_TOKEN, t.lower())) for t in TEMPLATES.values()]
    vocabulary = set().union(*docs)
    return {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in sorted(vocabulary)}


def template_vectors() -> list[tuple[str, str, float]]:
    """(licence, term, weight), each licence's weights of norm 1."""
    idf, out = _idf(), []
    for name, t in TEMPLATES.items():
        terms = re.findall(_TOKEN, t.lower())
        raw = {w: terms.count(w) * idf[w] for w in set(terms)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out += [(name, w, x / norm) for w, x in sorted(raw.items())]
    return out


def unknown_idf() -> float:
    return math.log(1 + len(TEMPLATES)) + 1


def block_vectors(df: dict[str, int], texts: int) -> tuple[list[str], list[str], list[dict[str, float]], dict[str, float], float]:
    """(terms, licence of each template, its weights of norm 1, idf of the terms, that of words outside
    the templates). df: how many of so many texts have a term; the templates count as texts too.
    Counts weigh 1 + ln, so that a body's common words do not outweigh its rare ones."""
    owners = [name for name, some in BLOCKS.items() for _ in some]
    counts = [Counter(re.findall(_TOKEN, t.lower())) for some in BLOCKS.values() for t in some]
    terms = sorted(set().union(*counts))
    n = 1 + texts + len(counts)
    idf = {w: math.log(n / (1 + df.get(w, 0) + sum(w in c for c in counts))) + 0.01 for w in terms}
    out = []
    for c in counts:
        raw = {w: (1 + math.log(k)) * idf[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append({w: x / norm for w, x in raw.items()})
    return terms, owners, out, idf, sorted(idf.values())[len(idf) // 2]


def block_anchors(vectors: list[dict[str, float]], threshold: float = THRESHOLD) -> set[str]:
    """Terms of which a text must have one to reach the threshold: without a template's heaviest terms
    the norm of its other weights, which bounds the cosine, is too small."""
    out: set[str] = set()
    for v in vectors:
        left = 1.0
        for w, x in sorted(v.items(), key=lambda kv: (-kv[1], kv[0])):
            if left < threshold * threshold - SLACK:
                break
            out.add(w)
            left -= x * x
    return out


def _constant(value, kind: str) -> Column:
    """A nested value as one literal, which the optimiser folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def own_blocks(files: DataFrame, key: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, similarity, line, lines) of the best block of each file that reaches the
    threshold; a line that names its licence by an SPDX identifier counts as similarity 1.

    Blocks are runs of BLOCK_LINES lines that overlap by three quarters, and the whole text. IDF is over all
    the files' texts and the templates. A word outside the templates counts as different from any
    other. All is worked out within the row: only the terms' document counts, at most as many as
    the templates have terms, are shuffled. Texts and blocks are left out only by the bound of
    block_anchors(). Null texts have no block; an empty table gives no rows.
    """
    some = files.where(F.col(text).isNotNull())
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f"({_TOKEN})"), F.lit(1))
    once = lambda e, f: F.get(F.transform(F.array(e), f), F.lit(0))  # noqa: E731, evaluates e a single time
    vocabulary = sorted({w for parts in BLOCKS.values() for t in parts for w in re.findall(_TOKEN, t.lower())})
    words = _constant(vocabulary, "array<string>")
    counted = some.select(F.explode(F.array_intersect(tokens(F.lower(text)), words)).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.collect()}  # at most one row a term of the templates
    terms, owners, vectors, idf, unknown = block_vectors(df, some.count())
    number = {w: k + 1 for k, w in enumerate(terms)}
    anchors = block_anchors(vectors, threshold)
    known = {name.lower(): name for name in BLOCKS}
    known |= {f"{k}-{end}": name for k, name in known.items() for end in ("only", "or-later")}
    weight, table = _constant([unknown, *[idf[w] for w in terms]], "array<double>"), _constant([[0.0, *[v.get(w, 0.0) for w in terms]] for v in vectors], "array<array<double>>")
    heavy = _constant(sorted(number[w] for w in anchors), "array<int>")
    names = F.array(*map(F.lit, owners))

    def cosine(x: Column) -> Column:
        """(similarity, template) of the block of term numbers x that comes nearest; 0 stands for a word outside."""
        own = F.transform(F.array_remove(F.array_distinct(x), 0), lambda i: F.struct(i.alias("i"), ((1 + F.log(F.size(F.filter(x, lambda y: y == i)).cast("double"))) * F.get(weight, i)).alias("w")))

        def best(d: Column) -> Column:
            square = F.aggregate(d, F.size(F.filter(x, lambda y: y == 0)) * F.lit(unknown * unknown), lambda a, e: a + e["w"] * e["w"])
            dots = F.transform(table, lambda t: F.aggregate(d, F.lit(0.0), lambda a, e: a + e["w"] * F.get(t, e["i"])))
            return once(F.sqrt(square), lambda n: F.array_max(F.transform(dots, lambda dot, k: F.struct(F.round(dot / n, 9).alias("similarity"), (-k).alias("k")))))

        return once(own, best)

    def blocks(n: Column) -> Column:
        """(line, lines) of every block of a text of n lines."""
        runs = [F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max(1, b // 4))), lambda a, b=b: F.struct(a.alias("line"), F.least(F.lit(b), n - a).alias("lines"))) for b in BLOCK_LINES]
        return F.array_distinct(F.concat(*runs, F.array(F.struct(F.lit(0).alias("line"), n.alias("lines")))))

    body = F.lower(text)
    may = some.where(F.arrays_overlap(tokens(body), _constant(sorted(anchors), "array<string>")) | F.contains(body, F.lit("spdx-license-identifier")))
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.transform(tokens(x), lambda t: F.array_position(words, t).cast("int")))
    named = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda t: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(t)))
    named = F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0))
    rows = may.select(F.col(key), lines.alias("ls"), named.alias("named"))
    # a generator between the two, so that the lines are worked out once
    rows = rows.select(key, "named", F.explode(F.array("ls")).alias("ls"))
    near = F.filter(blocks(F.size("ls")), lambda b: F.exists(F.slice("ls", b["line"] + 1, b["lines"]), lambda x: F.arrays_overlap(x, heavy)))
    judged = lambda b: once(cosine(F.flatten(F.slice("ls", b["line"] + 1, b["lines"]))), lambda c: F.struct(c["similarity"].alias("similarity"), (-b["line"]).alias("line"), (-b["lines"]).alias("lines"), c["k"].alias("k")))

    def moved(best: Column, step: Column) -> Column:
        """The best of a block and those whose ends lie up to two steps further in or out."""
        first, last, n = -best["line"], -best["line"] - best["lines"], F.size("ls")
        begins = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.least(F.greatest(first + i * step, F.lit(0)), n - 1))
        tries = F.flatten(F.transform(F.array_distinct(begins), lambda a: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda j: F.struct(a.alias("line"), (F.greatest(F.least(last + j * step, n), a + 1) - a).alias("lines")))))
        return F.array_max(F.concat(F.array(best), F.transform(F.array_distinct(tries), judged)))

    found = F.array_max(F.transform(near, judged))
    # the ends of a good block are then sought line by line, to tell licences of nearly equal words apart
    fine = lambda b: once(moved(b, F.greatest(F.lit(1), (-b["lines"] / 8).cast("int"))), lambda c: moved(c, F.lit(1)))
    rows = rows.select(key, "named", once(found, lambda b: F.when(b["similarity"] >= threshold, fine(b))).alias("b"))
    rows = rows.where(F.col("named").isNotNull() | (F.col("b.similarity") >= threshold))
    licence = F.coalesce("named", F.get(names, -F.col("b.k")))
    out = rows.select(key, licence.alias("licence"), F.when(F.col("named").isNotNull(), 1.0).otherwise(F.col("b.similarity")).alias("similarity"), F.when(F.col("named").isNull(), -F.col("b.line")).alias("line"), F.when(F.col("named").isNull(), -F.col("b.lines")).alias("lines"))
    return out.groupBy(key).agg(F.min_by(F.struct("licence", "similarity", "line", "lines"), F.struct(-F.col("similarity"), F.col("line"), F.col("lines"), F.col("licence"))).alias("b")).select(key, "b.*")


def shares_enough(line: Column, threshold: float) -> Column:
    """Whether a lower-case line has the letters of terms that can reach the threshold with one
    template: a cosine is at most the norm of the template's weights of the terms they share."""
    squares: dict[str, Column] = {}
    for name, term, v in template_vectors():
        squares[name] = squares.get(name, F.lit(0.0)) + F.when(F.contains(line, F.lit(term)), v * v).otherwise(0.0)
    return reduce(or_, [total >= threshold * threshold - SLACK for total in squares.values()])


def comes_near(line: Column, threshold: float) -> Column:
    """Whether the cosine with one template may reach the threshold if no term of a lower-case line
    came twice: the line's norm is at least that of its terms one by one."""
    idf, unknown = _idf(), unknown_idf()
    once = lambda e, f: F.transform(F.array(e), f)[0]  # noqa: E731, evaluates e a single time
    values = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    total = lambda terms, d: F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(values(d), t), F.lit(0.0)))
    dots: dict[str, dict[str, float]] = {}
    for name, term, v in template_vectors():
        dots.setdefault(name, {})[term] = idf[term] * v

    def near(terms: Column, known: Column) -> Column:
        square = total(known, {t: x * x for t, x in idf.items()}) + (F.size(terms) - F.size(known)) * unknown * unknown
        return once(F.sqrt(square), lambda norm: reduce(or_, [total(known, d) >= (threshold - SLACK) * norm for d in dots.values()]))

    terms = F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1))
    return once(terms, lambda t: once(F.filter(t, lambda x: x.isin(*idf)), lambda known: near(t, known)))


def own_licences(spark: SparkSession, files: DataFrame, key: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, similarity, line) of the best line of each file that reaches the threshold;
    line counts from 0. Ties go to the earlier line, then to the name. Null texts have no line.
    Every line is compared unless a bound from the vectors, worked out within its row, shows that
    it cannot reach the threshold.
    """
    at, line = "_line", "_text"
    lines = files.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.lower(text), "\n", -1)).alias(at, line))
    lines = staged(lines.where(shares_enough(F.col(line), threshold) & comes_near(F.col(line), threshold)), "licence-lines")
    idf = F.create_map(*[F.lit(x) for kv in _idf().items() for x in kv])
    terms = lines.select(key, at, F.explode(F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1))).alias("term")).groupBy(key, at, "term").count()
    terms = terms.withColumn("w", F.col("count") * F.coalesce(F.try_element_at(idf, F.col("term")), F.lit(unknown_idf())))
    # the templates' terms, a fixed table of this module
    templates = F.broadcast(spark.createDataFrame(template_vectors(), "licence string, term string, v double"))
    norms = terms.groupBy(key, at).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(templates, "term").groupBy(key, at, "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, [key, at]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("similarity") >= threshold)
    best = F.min_by(F.struct("licence", "similarity", at), F.struct(-F.col("similarity"), F.col(at), F.col("licence")))
    return cosine.groupBy(key).agg(best.alias("b")).select(key, F.col("b.licence").alias("licence"), F.col("b.similarity").alias("similarity"), F.col(f"b.{at}").alias("line"))


def ancestors(path: Column) -> Column:
    """Array of (depth, dir): every directory above a path, the root '' at depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))


def scan(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text, is_licence_file, ...) with own_licence, similarity, licence and
    inherited_from (the directory, null where the licence is the file's own or none).

    Paths use '/', without one at the start. Where a directory holds several licence files the
    most similar counts, then the first name. A file's own licence is that of its best line or block of
    lines, the more similar of the two. Null paths inherit nothing. Repeated paths share
    what is found in any of their rows. Extra columns stay; clashing names are prefixed. Null and empty
    texts have no licence of their own; texts are read to their end; an empty table gives no rows.
    """
    own, sim, lic, frm, p = free_name(files, "own_licence", "similarity", "licence", "inherited_from", "scan_path")
    named = files.where(F.col("path").isNotNull())
    by_line = own_licences(spark, named, threshold=threshold).select("path", F.lit(0).alias("rank"), "licence", "similarity")
    by_block = own_blocks(named, threshold=threshold).select("path", F.lit(1).alias("rank"), "licence", "similarity")
    both = by_line.unionByName(by_block).groupBy("path").agg(F.min_by(F.struct("licence", "similarity"), F.struct(-F.col("similarity"), F.col("rank"), F.col("licence"))).alias("b"))
    found = staged(both.select(F.col("path").alias(p), F.col("b.licence").alias(own), F.col("b.similarity").alias(sim)), "licences")
    found_b, _ = bounded_broadcast(found)
    df = files.join(found_b, files["path"] == found_b[p], "left").drop(p)
    dir_of = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    dirs = files.where("is_licence_file").select("path", dir_of.alias("dir")).distinct().join(found, F.col("path") == F.col(p)).groupBy("dir").agg(F.min_by(F.col(own), F.struct(-F.col(sim), F.col(own))).alias("dir_licence"))
    dirs, _ = bounded_broadcast(staged(dirs, "licence-dirs"))
    # one row per path and ancestor, without texts; the directory nearest to the file wins
    up = files.where(F.col("path").isNotNull()).select("path").distinct().withColumn("a", F.explode(ancestors(F.col("path")))).select("path", F.col("a.depth").alias("depth"), F.col("a.dir").alias("dir"))
    near = up.join(dirs, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("n")).select(F.col("path").alias(p), F.col("n.dir").alias(frm), F.col("n.dir_licence").alias(lic))
    df = df.join(near, df["path"] == near[p], "left").drop(p)
    return df.withColumns({lic: F.coalesce(own, lic), frm: F.when(F.col(own).isNull(), F.col(frm))})


def corpus_files(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/hundred/doc_id; a document whose first or last line declares a
    licence stands for the licence file of its directory. Null parts of a path are ``_``; null and
    empty texts declare nothing; repeated ids share a path; an empty table gives no files."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("_"))
    path = F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id")))
    text = F.coalesce("text", F.lit(""))
    declares = F.substring_index(text, "\n", 1).rlike(ANCHOR) | F.substring_index(text, "\n", -1).rlike(ANCHOR)
    return docs.select("doc_id", path.alias("path"), "text", declares.alias("is_licence_file"))
