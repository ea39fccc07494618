"""Licence scans by Dice coefficient over word bigrams, in DataFrame operations only (operator 1).

A document is cut into units: its lines, the sentences of lines that have several, its paragraphs of more than one line
(a line without letters and digits ends one, so comment signs do not matter), runs of two to ``RUN`` neighbouring
paragraphs, and the whole text if it has more than one paragraph. Words are runs of a-z and 0-9 after A-Z are lower-cased; a unit's bigrams are its pairs of neighbouring
words, repeats counted. The Dice coefficient of a unit and a template is twice the shared bigrams over the bigrams of
both. With a least coefficient t it needs sizes whose ratio is between t / (2 - t) and (2 - t) / t, so only templates
of such a size are compared, and a unit takes part only if the bigrams that any template has make up t / (2 - t) of
its own: neither bound can lose a match.

For the same reason a match has all but 1 - t / (2 - t) of its template's bigrams. *Key words* are chosen so that more
than that share of every template's bigrams have one of them in it: a text or unit without any key word (long ones even as part
of other words) matches no template, and is left out before its words are looked at.

Everything is computed within a row: no shuffle, whatever the keys' distribution.

Cases: null and empty texts and units under two words match nothing; of templates that match equally well the one
last in order is named; overlapping units that match are all reported; repeated rows repeat their matches; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Paragraphs of a run at most.
RUN = 6
#: Licences and licence notices as projects write them, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
BSD_ONE = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
BSD_TWO = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""
#: A notice of the GNU licences: what the work calls itself, the licence's name and version, and where a copy is.
GNU_GRANT = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
GNU_REST = """This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.

You should have received a copy of the GNU {name} Public License along with this {work}{where}"""
GNU_WEB = ". If not, see <https://www.gnu.org/licenses/>."
GNU_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
GNU = [
    ("GPL-2.0", "program", "General", "2", GNU_POST),
    ("GPL-3.0", "program", "General", "3", GNU_WEB),
    ("LGPL-2.1", "library", "Lesser General", "2.1", GNU_POST),
    ("LGPL-3.0", "library", "Lesser General", "3", GNU_WEB),
    ("AGPL-3.0", "program", "Affero General", "3", GNU_WEB),
]
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License {version}
which is available at https://www.eclipse.org/legal/epl-{version}"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
the following:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: Creative Commons: what an identifier's letters stand for, and the licence's port by version.
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_PORTS = {"3.0": "Unported", "4.0": "International"}
#: GNU licences by family: names, and the versions that there are.
GNU_VERSIONS = {"GPL": ("work", "General", ("1", "2", "3")), "LGPL": ("library", "Lesser General", ("2.1", "3")), "AGPL": ("work", "Affero General", ("3",))}


def _rivals() -> list[tuple[str, str]]:
    """Licences that differ in few words, each in its usual forms, so that the nearest one is named."""
    out = []
    for letters, terms in CC_TERMS.items():
        for version, port in CC_PORTS.items():
            spdx = f"CC-{letters}-{version}"
            out += [(spdx, f"Licensed under CC {letters} {version}."), (spdx, f"This work is licensed under a Creative Commons {terms} {version} {port} License."), (spdx, f"SPDX-License-Identifier: {spdx}")]
    for family, (work, name, versions) in GNU_VERSIONS.items():
        for version in versions:
            spdx = f"{family}-{version}" if "." in version else f"{family}-{version}.0"
            notice = f"This {work} is licensed under the GNU {name} Public License, version {version}"
            out += [(spdx, f"{notice}."), (f"{spdx}-only", f"{notice} only."), (f"{spdx}-or-later", f"{notice} or (at your option) any later version.")]
            out += [(f"{spdx}{more}", f"SPDX-License-Identifier: {spdx}{more}") for more in ("-only", "-or-later")]
    for spdx in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0"):
        out.append((spdx, f"SPDX-License-Identifier: {spdx}"))
    out += [(f"EPL-{version}", EPL.format(version=version)) for version in ("1.0", "2.0")]
    out += [("BSL-1.0", BOOST), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("MPL-2.0", MPL), ("BSD", "Released under the BSD License.")]
    return out


TEMPLATES = [
    ("MIT", MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_ONE} {BSD_TWO} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_ONE} {BSD_TWO} {BSD_THREE} {BSD_END}"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    *[(spdx, GNU_GRANT.format(work=work, name=name, version=version)) for spdx, work, name, version, _ in GNU],
    *[(spdx, (GNU_GRANT + GNU_REST).format(work=work, name=name, version=version, where=where)) for spdx, work, name, version, where in GNU],
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.""",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *_rivals(),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between paragraphs, and between sentences of a line.
BLANK_LINE = r"\n[^a-zA-Z0-9\n]*\n"
SENTENCE_END = r"[.!?;:]+[ \t]+"


def template_bigrams(text: str) -> Counter:
    words = re.findall("[a-z0-9]+", text.lower())
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def key_words(counted: list[tuple[str, Counter]], threshold: float) -> list[str]:
    """Words of which every match has one; those that cover most bigrams first, long ones rather than short ones."""
    chosen: list[str] = []
    for _, bigrams in sorted(counted, key=lambda t: sum(t[1].values())):
        spare = sum(bigrams.values()) * (1 - threshold / (2 - threshold)) + 1e-9
        while sum(c for b, c in bigrams.items() if not set(b.split()).isdisjoint(chosen)) <= spare:
            gain: Counter = Counter()
            for b, c in bigrams.items():
                if set(b.split()).isdisjoint(chosen):
                    for word in set(b.split()):
                        gain[word] += c
            chosen.append(max(gain, key=lambda w: (len(w) > 5, gain[w], len(w), w)))
    return chosen


def _has_any(text: Column, words: list[str]) -> Column:
    """Whether a text has some of the words: long ones even inside other words, short ones as words of their own.

    The text is lower-cased once, as the only element of an array, and not for each word.
    """

    def tests(low: Column) -> Column:
        found = [F.contains(low, F.lit(w)) if len(w) > 3 else low.rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)") for w in words]
        return reduce(lambda a, b: a | b, found) if found else F.lit(False)

    return F.exists(F.array(F.lower(text)), tests)


def units(docs: DataFrame, keys: list[str], most_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, position, part, words) of units with a key word and at most so many words.

    position counts lines or paragraphs from 1; part is the place of a sentence in its line, or a run's number of paragraphs.
    """
    docs = docs.select(id_col, text_col).filter(_has_any(F.col(text_col), keys))
    text = F.col(text_col)
    lines, paragraphs = F.split(text, "\n"), F.split(text, BLANK_LINE)

    def unit(kind: str, position: Column, part: Column | int, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), position.alias("position"), (F.lit(part) if isinstance(part, int) else part).alias("part"), body.alias("body"))

    def words(body: Column) -> Column:
        return F.filter(F.split(F.translate(body, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")

    whole = F.transform(lines, lambda t, i: unit("line", i + 1, 1, t))
    sentences = F.flatten(F.transform(lines, lambda t, i: F.when(t.rlike(SENTENCE_END), F.transform(F.split(t, SENTENCE_END), lambda x, k: unit("sentence", i + 1, k + 1, x))).otherwise(F.array().cast(_UNITS))))
    long = F.filter(F.transform(paragraphs, lambda t, i: unit("paragraph", i + 1, 1, t)), lambda e: F.contains(e["body"], F.lit("\n")))
    some = docs.select(id_col, F.explode(F.concat(whole, sentences, long)).alias("e")).filter(_has_any(F.col("e.body"), keys))
    some = some.select(id_col, "e.unit", "e.position", "e.part", words(F.col("e.body")).alias("words"))
    # Runs of paragraphs and whole texts from their paragraphs' words, so that too long ones are never put together.
    parted = docs.select(id_col, F.transform(paragraphs, words).alias("p")).filter(F.size("p") > 1)
    parted = parted.withColumns({"n": F.size("p"), "sizes": F.transform("p", lambda w: F.size(w))})

    def total(first: Column, k: Column) -> Column:
        return F.aggregate(F.slice("sizes", first, k), F.lit(0), lambda a, b: a + b)

    def runs(first: Column) -> Column:
        counts = F.sequence(F.lit(2), F.least(F.lit(RUN), F.col("n") - first + 1))
        fitting = F.filter(counts, lambda k: (k < F.col("n")) & (total(first, k) <= most_words))
        return F.transform(fitting, lambda k: F.struct(F.lit("run").alias("unit"), first.alias("position"), k.alias("part"), F.flatten(F.slice("p", first, k)).alias("words")))

    run = F.when(F.col("n") > 2, F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), runs))).otherwise(F.array().cast(_WORDS))
    every = F.when(F.aggregate("sizes", F.lit(0), lambda a, b: a + b) <= most_words, F.array(F.struct(F.lit("text").alias("unit"), F.lit(1).alias("position"), F.lit(1).alias("part"), F.flatten("p").alias("words")))).otherwise(F.array().cast(_WORDS))
    joined = parted.select(id_col, F.explode(F.concat(run, every)).alias("e")).select(id_col, "e.*")
    return some.filter(F.size("words") <= most_words).unionByName(joined)


_UNITS = "array<struct<unit: string, position: int, part: int, body: string>>"
_WORDS = "array<struct<unit: string, position: int, part: int, words: array<string>>>"
_KNOWN = "array<struct<license: string, n: int, has: array<struct<b: string, c: int>>>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, position, part, license, dice): the best template of each unit that reaches the threshold."""
    counted = [(name, template_bigrams(text)) for name, text in templates]
    ratio = threshold / (2 - threshold)
    some = sorted({b for _, bigrams in counted for b in bigrams})
    most = int(max((sum(bigrams.values()) for _, bigrams in counted), default=0) / ratio) + 1
    rows = units(docs, key_words(counted, threshold), most, id_col, text_col).filter(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    keys = [id_col, "unit", "position", "part"]
    rows = rows.select(*keys, pairs.alias("bigrams"))
    n = F.size("bigrams")
    rows = rows.filter(F.size(F.filter("bigrams", lambda b: b.isin(some))) >= n * ratio - 1e-9)
    known = F.from_json(F.lit(json.dumps([{"license": name, "n": sum(bigrams.values()), "has": [{"b": b, "c": c} for b, c in sorted(bigrams.items())]} for name, bigrams in counted])), _KNOWN)
    sized = F.filter(known, lambda t: (t["n"] >= n * ratio - 1e-9) & (t["n"] * ratio <= n + 1e-9))

    def dice(t: Column) -> Column:
        shared = F.aggregate(t["has"], F.lit(0), lambda total, e: total + F.least(e["c"], F.size(F.filter("bigrams", lambda b: b == e["b"]))))
        return F.struct((shared * 2.0 / (n + t["n"])).alias("dice"), t["license"].alias("license"))

    found = rows.select(*keys, F.array_max(F.transform(sized, dice)).alias("best")).filter(F.col("best.dice") >= threshold)
    return found.select(id_col, "unit", F.col("position").cast("long").alias("position"), F.col("part").cast("long").alias("part"), "best.license", F.round("best.dice", 6).alias("dice"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows of documents as DuckDB SQL, from the definition: all units against all templates of fitting size."""
    values = ", ".join("(%d, '%s', '%s', %d)" % (k, name, b, c) for k, (name, text) in enumerate(templates) for b, c in sorted(template_bigrams(text).items()))
    return f"""
    WITH t(k, license, b, c) AS (VALUES {values}),
    size AS (SELECT k, license, sum(c) AS n FROM t GROUP BY k, license),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, doc_id, 'line' AS unit, generate_subscripts(p, 1) AS position, 1 AS part, unnest(p) AS body FROM (SELECT r, doc_id, string_split(text, chr(10)) AS p FROM d)),
    sentences AS (SELECT r, doc_id, 'sentence' AS unit, position, generate_subscripts(p, 1) AS part, unnest(p) AS body
        FROM (SELECT r, doc_id, position, string_split_regex(body, '{SENTENCE_END}') AS p FROM lines) WHERE len(p) > 1),
    split AS (SELECT r, doc_id, text, string_split_regex(text, '{BLANK_LINE}') AS p FROM d),
    paragraphs AS (SELECT r, doc_id, 'paragraph' AS unit, generate_subscripts(p, 1) AS position, 1 AS part, unnest(p) AS body FROM split),
    runs AS (SELECT r, doc_id, 'run' AS unit, position, k AS part, array_to_string(p[position:position + k - 1], chr(10)) AS body
        FROM split, (SELECT unnest(range(2, {RUN + 1})) AS k), LATERAL (SELECT unnest(range(1, len(p) - k + 2)) AS position) WHERE k < len(p)),
    units AS (SELECT * FROM lines UNION ALL SELECT * FROM sentences UNION ALL SELECT * FROM paragraphs WHERE contains(body, chr(10))
        UNION ALL SELECT * FROM runs UNION ALL SELECT r, doc_id, 'text', 1, 1, text FROM split WHERE len(p) > 1),
    w AS (SELECT r, doc_id, unit, position, part, list_filter(string_split_regex(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units),
    b AS (SELECT r, doc_id, unit, position, part, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
    c AS (SELECT r, doc_id, unit, position, part, n, b, count(*) AS c FROM b GROUP BY ALL),
    s AS (SELECT c.r, doc_id, unit, position, part, c.n, t.k, sum(least(c.c, t.c)) AS shared FROM c JOIN t USING (b) GROUP BY ALL),
    p AS (SELECT r, doc_id, unit, position, part, size.license, CAST(shared * 2.0 AS DOUBLE) / CAST(s.n + size.n AS DOUBLE) AS dice FROM s JOIN size USING (k)),
    best AS (SELECT *, row_number() OVER (PARTITION BY r, unit, position, part ORDER BY dice DESC, license DESC) AS place FROM p)
    SELECT doc_id, unit, CAST(position AS BIGINT) AS position, CAST(part AS BIGINT) AS part, license, round(dice, 6) AS dice FROM best WHERE place = 1 AND dice >= {threshold}
    """
