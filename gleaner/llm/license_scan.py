"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

Templates are whole short licences, the titles and notices of long ones, and SPDX headers. Every file is compared by
windows: 1 to 35 lines that begin at a line with a strong word; a licence file by its whole text too. Document
frequencies of the templates' words are counted over all files first; a word of no template weighs as much as theirs do
on average, so scores don't rise with the number of files. Files are skipped only where a bound proves them below the
threshold: without any template's strong words, its weak words alone cannot reach it.

A licence file's licence holds for its folder. A file without one of its own takes that of the nearest folder above it,
found by joining all its folders' ancestors; folders are made distinct first, so a huge folder is one row there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, texts_of

LEAST = 0.6
#: Lines of a window.
WINDOWS = (1, 2, 3, 4, 6, 9, 13, 18, 25, 35)

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"


def _gnu(name: str, short: str, version: str, date: str) -> dict[str, list[str]]:
    title = f"GNU {name} Public License"
    tail = f"as published by the Free Software Foundation, version {version}"
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the"
    none = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details."
    number = version if "." in version else version + ".0"
    return {f"{short}-{number}": [f"Licensed under the {title} version {version}.", f"{title} Version {version}, {date}", f"{free} {title} {tail}", f"{free} {title} {tail} of the License, or (at your option) any later version. {none}", f"SPDX-License-Identifier: {short}-{number}-only", f"SPDX-License-Identifier: {short}-{number}-or-later"]}


def _creative(words: str, short: str) -> dict[str, list[str]]:
    return {f"CC-{short.replace(' ', '-')}-4.0": [f"Licensed under the Creative Commons {words} 4.0 International License.", f"Licensed under CC {short} 4.0.", f"Creative Commons {words} 4.0 International Public License", f"This work is licensed under a Creative Commons {words} 4.0 International License."]}


#: Whole short licences; titles, notices and usual wordings of the others.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License", *_MIT, " ".join(_MIT)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "ISC": ["Released under the ISC License.", "ISC License", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"],
    "0BSD": ["Zero-Clause BSD License", f"{_GRANT}. {_AS_IS}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{_FORMS} {_NO_NAME} {_HOLDERS}", _NO_NAME],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{_FORMS} {_HOLDERS}", _FORMS],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", _BOOST],
    "Zlib": ["Released under the zlib license.", _ZLIB],
    "Unlicense": ["Released under the Unlicense.", _UNLICENSE],
    "CC0-1.0": ["Released under CC0 1.0 Universal public domain dedication.", "Creative Commons CC0 1.0 Universal", "This work is dedicated to the public domain."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    **_gnu("General", "GPL", "2", "June 1991"),
    **_gnu("General", "GPL", "3", "29 June 2007"),
    **_gnu("Affero General", "AGPL", "3", "19 November 2007"),
    **_gnu("Lesser General", "LGPL", "2.1", "February 1999"),
    **_gnu("Lesser General", "LGPL", "3", "29 June 2007"),
    **_creative("Attribution", "BY"),
    **_creative("Attribution ShareAlike", "BY SA"),
    **_creative("Attribution NonCommercial", "BY NC"),
    **_creative("Attribution NoDerivatives", "BY ND"),
    **_creative("Attribution NonCommercial ShareAlike", "BY NC SA"),
    **_creative("Attribution NonCommercial NoDerivatives", "BY NC ND"),
}
for _name in TEMPLATES:
    if _name != "Proprietary":
        TEMPLATES[_name].append(f"SPDX-License-Identifier: {_name}")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FILE = re.compile(r"(?i)^(licen[cs]e|copying|notice|unlicense)(\b|[._-])")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of all templates, from document frequencies of their words in n files."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, least: float):
        self.least = least
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for texts in templates.values() for t in texts for w in words(t)}
        self.other = sum(self.idf.values()) / max(len(self.idf), 1)
        self.names: list[str] = []
        self.index: dict[str, list[tuple[int, float]]] = {}
        vectors = []
        for name in sorted(templates):
            for t in templates[name]:
                v = {w: c * self.idf[w] for w, c in Counter(words(t)).items()}
                size = math.sqrt(sum(x * x for x in v.values()))
                for w, x in v.items():
                    self.index.setdefault(w, []).append((len(self.names), x / size * self.idf[w]))
                vectors.append({w: (x / size) ** 2 for w, x in v.items()})
                self.names.append(name)
        # The weakest words, as long as no template reaches the threshold by them alone.
        held, weak = [0.0] * len(vectors), set()
        for w in sorted(self.idf, key=lambda w: (self.idf[w], w)):
            more = [(i, vectors[i][w]) for i, _ in self.index[w]]
            if all(held[i] + x < least * least for i, x in more):
                weak.add(w)
                for i, x in more:
                    held[i] += x
        self.strong = frozenset(self.idf) - weak

    def best(self, found: Counter) -> tuple[float, str]:
        """The largest cosine of a bag of words and its licence; of equals the first by name."""
        if self.strong.isdisjoint(found):
            return 0.0, ""
        size, dots = 0.0, {}
        for w, c in found.items():
            size += (c * self.idf.get(w, self.other)) ** 2
            for i, x in self.index.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * c
        top, size = (0.0, ""), math.sqrt(size)
        for i in sorted(dots):
            if dots[i] / size > top[0] + 1e-12:
                top = (dots[i] / size, self.names[i])
        return top

    def scan(self, text: str, licence_file: bool) -> tuple[float, str, int]:
        """Score, licence and line (1-based; 0 for the whole text) of the best match: the whole first, then the first window, the shorter of two."""
        top = (0.0, "", 0)
        whole = words(text)
        if self.strong.isdisjoint(whole):
            return top
        if licence_file:
            top = (*self.best(Counter(whole)), 0)
        lines = text.split("\n")
        bags: dict[int, list[str]] = {}

        def bag(i: int) -> list[str]:
            if i not in bags:
                bags[i] = words(lines[i])
            return bags[i]

        for i in range(len(lines)):
            if self.strong.isdisjoint(bag(i)):
                bags.pop(i - 1, None)
                continue
            found: Counter = Counter()
            end = i
            for size in WINDOWS:
                if end >= len(lines):
                    break
                for j in range(end, min(i + size, len(lines))):
                    found.update(bag(j))
                end = i + size
                score, name = self.best(found)
                if score > top[0] + 1e-12:
                    top = (score, name, i + 1)
            bags.pop(i - 1, None)
        return top if top[0] >= self.least else (0.0, "", 0)


def _count(vocabulary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, Counter()
        for batch in batches:
            for t in texts_of(batch.column("text")):
                total += 1
                df.update(vocabulary.intersection(words(t.decode("utf-8", "replace"))))
        rows = [("", total), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([c for _, c in rows], pa.int64())], ["word", "files"])

    return run


def _scan(templates: Templates, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [(p or "").rpartition("/")[2] for p in batch.column("path").to_pylist()]
            is_file = [bool(_FILE.search(x)) for x in names]
            found = [templates.scan(t.decode("utf-8", "replace"), f) for t, f in zip(texts_of(batch.column("text")), is_file, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(is_file), pa.array([x[1] or None for x in found], pa.string()), pa.array([x[0] for x in found]), pa.array([x[2] for x in found], pa.int64())], [*columns, "licence_file", "own", "score", "line"])

    return run


def scan_licenses(files: DataFrame, carry: tuple[str, ...] = (), templates: dict[str, list[str]] | None = None, least: float = LEAST, path: str = "path", text: str = "text") -> DataFrame:
    """One row per row of files: carried columns, path, license, score, line, via, source_path.

    via: 'own' (lines or the text of the file), 'inherited' (license of the nearest folder's licence file, its path
    in source_path and its score) or 'none' (license null, score 0). Several licence files in one folder: the highest
    score, then the smallest path. A null path is a file outside of all folders; a null text is empty. Repeated rows
    are kept. Other columns are ignored; an empty table gives no rows.
    """
    table = templates or TEMPLATES
    own = files.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    vocabulary = frozenset(w for texts in table.values() for t in texts for w in words(t))
    counted = own.select("text").mapInArrow(_count(vocabulary), "word string, files long").groupBy("word").agg(F.sum("files").alias("files"))
    df = {r["word"]: r["files"] for r in counted.collect()}
    kept = [*[f"_c{i}" for i in range(len(carry))], "path"]
    kinds = dict(own.dtypes)
    scanned = own.mapInArrow(_scan(Templates(table, df, df.get("", 0), least), kept), ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", licence_file boolean, own string, score double, line long")
    scanned = materialize(scanned.withColumn("dir", F.expr("if(path is null, null, if(contains(path, '/'), left(path, length(path) - length(substring_index(path, '/', -1)) - 1), ''))")), "license-scan")
    held = scanned.where("licence_file AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("l"))
    above = scanned.where("own IS NULL AND dir IS NOT NULL").select("dir").distinct()
    steps = F.expr("transform(sequence(0, if(dir = '', 0, size(split(dir, '/')))), i -> struct(i as depth, array_join(slice(split(dir, '/'), 1, i), '/') as folder))")
    above = above.select("dir", F.explode(steps).alias("a")).select("dir", "a.depth", "a.folder")
    nearest = above.join(held.select(F.col("dir").alias("folder"), "l"), "folder").groupBy("dir").agg(F.max(F.struct("depth", "l")).alias("n")).select("dir", F.col("n.l.own").alias("theirs"), (-F.col("n.l.s")).alias("their_score"), F.col("n.l.path").alias("their_path"))
    out = scanned.join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "path",
        F.when(mine, F.col("own")).otherwise(F.col("theirs")).alias("license"),
        F.when(mine, F.col("score")).otherwise(F.coalesce("their_score", F.lit(0.0))).alias("score"),
        "line",
        F.when(mine, "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~mine, F.col("their_path")).alias("source_path"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/folder of 50 ids/id.txt. What speaks of a licence is its folder's LICENSE file, every tenth of them its language's."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    deep = F.concat_ws("/", top, F.expr("cast(floor(doc_id / 50) as string)"))
    speaks = F.lower("text").rlike("licen[cs]|public domain")
    name = F.when(speaks & (F.pmod("doc_id", F.lit(10)) == 0), F.concat(top, F.lit("/LICENSE."), F.col("doc_id"))).when(speaks, F.concat(deep, F.lit("/LICENSE."), F.col("doc_id")))
    return docs.select("doc_id", "text", F.coalesce(name, F.concat(deep, F.lit("/"), F.col("doc_id"), F.lit(".txt"))).alias("path"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a source tree."""
    return scan_licenses(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")), carry=("doc_id",))
