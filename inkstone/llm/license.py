"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Every segment (line, or sentence of a line) of every whole text is compared with every
   template by the cosine of TF-IDF vectors; document frequencies of the templates' words are
   counted over all documents (other words count as seen nowhere else, the highest weight). A
   bound from the words shared with any template rules out most segments exactly.
2. A file's own notice is its best segment at or above ``similar``. The whole file is compared
   with whole licence texts, long ones in full (``licenses/``), under measures made for long texts:
   counts are damped (1 + ln n) so that function words don't decide, and weights come from the
   licence texts alone, so that the corpus has no say in which licence a text is. At or above
   ``alike`` the nearest text decides, and makes the file a licence file. So is a file that
   consists of notices for half its words or more. Licence files speak for their directory.
3. Directories are made distinct, their ancestors joined with the directories that have a licence
   file, and the deepest kept; files without a notice inherit from their directory's row.

Defined cases: null and empty texts have no notice but inherit; a null path has no directory;
a notice that only reserves rights gives way to any other; of equal cosines the template's name
decides (ascending), then the lowest id; repeated rows are each answered; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, stored

#: Least cosines of a segment with a notice, and of a whole file with a whole licence.
SIMILAR, ALIKE = 0.6, 0.75
#: The name of notices that only reserve rights: any other notice of the same file goes before them.
RESERVED = "Proprietary"
#: Parts in which the files of one directory are joined with its row.
SALTS = 16
#: Notices by SPDX-style name; a parameter of the operator.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorised copying of this file is strictly prohibited."),
}
# Whole licence texts, as their stewards publish them.
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
#: Whole texts by SPDX-style name; a parameter of the operator. Longer licences stand with the notice that their appendix asks for,
#: and in full as the fixed texts of the folder licenses.
WHOLE = {
    "MIT": (
        "MIT License. Copyright. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "ISC License. Copyright. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License. Copyright. All rights reserved. " + _REDISTRIBUTION + _DISCLAIMER,),
    "BSD-3-Clause": (
        "BSD 3-Clause License. Copyright. All rights reserved. " + _REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. " + _DISCLAIMER,
    ),
    "Apache-2.0": (
        "Copyright. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "Copyright. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see https://www.gnu.org/licenses/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}
for _path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    WHOLE[_path.stem] = (*WHOLE.get(_path.stem, ()), _path.read_text())
_SEGMENT = re.compile(r"\n|(?<=[.!?]) +(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def document_frequencies(docs: DataFrame, vocabulary: set[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of the vocabulary (a few hundred rows on the driver)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for b in batches:
            n += b.num_rows
            for t in b.column(0):
                seen.update(vocabulary.intersection(words_of(t.as_py() or "")))
        words = ["", *sorted(seen)]  # the empty word stands for all documents
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([n, *(seen[w] for w in words[1:])], pa.int64())})

    counts = docs.select(F.col(text).cast("string")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    return found.pop("", 0), found


class Matcher:
    """Cosines of segments to templates, under given document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], total: int, seen: dict[str, int], similar: float = SIMILAR) -> None:
        self.similar, self.rare = similar, math.log(total + 1) + 1
        self.idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for ts in templates.values() for t in ts for w in words_of(t)}
        self.templates: list[tuple[str, dict[str, float]]] = []
        for name in sorted(templates):
            for t in templates[name]:
                v = {w: n * self.idf[w] for w, n in Counter(words_of(t)).items()}
                length = math.sqrt(sum(x * x for x in v.values()))
                self.templates.append((name, {w: x / length for w, x in v.items()}))
        self.most = {w: max(v.get(w, 0.0) for _, v in self.templates) for w in self.idf}

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """Highest cosine at or above similar, and its template; exact."""
        idf, shared = self.idf, [w for w in words if w in self.idf]
        if not shared:
            return None
        # at least this long: repeated other words only make it longer
        least = math.sqrt((len(words) - len(shared)) * self.rare**2 + sum(idf[w] ** 2 for w in shared))
        if sum(idf[w] * self.most[w] for w in shared) < self.similar * least:
            return None
        v = {w: n * idf.get(w, self.rare) for w, n in Counter(words).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        top = max(((sum(x * t.get(w, 0.0) for w, x in v.items()) / length, name) for name, t in self.templates), key=lambda p: (round(p[0], 9), [-ord(c) for c in p[1]]))
        return (round(top[0], 9), top[1]) if top[0] >= self.similar - 1e-12 else None

    def notice(self, text: str | None, whole: WholeTexts | None = None) -> tuple[float | None, str | None, bool]:
        """Cosine and licence, and whether the text is a licence file: it is like a whole licence text, or notices (the best
        segment decides) make up half of its words."""
        top, inside, total, every = None, 0, 0, Counter()
        for segment in _SEGMENT.split(text) if text else ():
            words = words_of(segment)
            every.update(words)
            total += len(words)
            if found := self.best(words):
                inside += len(words)
                if top is None or (found[1] == RESERVED, -found[0], found[1]) < (top[1] == RESERVED, -top[0], top[1]):
                    top = found
        if whole and (found := whole.best(every)):
            return *found, True
        return (*top, 2 * inside >= total) if top else (None, None, False)


class WholeTexts:
    """Cosines of whole files to whole licence texts: damped counts, weights by the texts alone."""

    def __init__(self, texts: dict[str, tuple[str, ...]], alike: float = ALIKE) -> None:
        self.alike = alike
        counts = [(name, Counter(words_of(t))) for name in sorted(texts) for t in texts[name]]
        among = Counter(w for _, c in counts for w in c)
        self.idf = {w: math.log((len(counts) + 1) / (n + 1)) + 1 for w, n in among.items()}
        self.other = math.log(len(counts) + 1) + 1  # of words that no licence has
        self.texts = []
        for name, c in counts:
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in c.items()}
            length = math.sqrt(sum(x * x for x in v.values()))
            self.texts.append((name, {w: x / length for w, x in v.items()}))

    def best(self, words: Counter) -> tuple[float, str] | None:
        """Highest cosine at or above alike, and its licence; of equal ones the first name."""
        shared = [w for w in words if w in self.idf]
        # what is shared must carry alike^2 of the squared length; every other word weighs other or more
        inside = sum(((1 + math.log(words[w])) * self.idf[w]) ** 2 for w in shared)
        if inside < self.alike**2 * (inside + (len(words) - len(shared)) * self.other**2):
            return None
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.other) for w, n in words.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        if not length:
            return None
        each = [(round(sum(v[w] * t.get(w, 0.0) for w in shared) / length, 9), name) for name, t in self.texts]
        top = min(each, key=lambda p: (-p[0], p[1]))
        return top if top[0] >= self.alike else None


def notices(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, similar: float = SIMILAR, whole: dict[str, tuple[str, ...]] = WHOLE, alike: float = ALIKE) -> DataFrame:
    """(id, path, cosine, license, is_file) of files (id, path, text)."""
    vocabulary = {w for ts in templates.values() for t in ts for w in words_of(t)}
    total, seen = document_frequencies(files, vocabulary)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, files = Matcher(templates, total, seen, similar), WholeTexts(whole, alike)
        for b in batches:
            found = [matcher.notice(t.as_py(), files) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_())],
                names=["id", "path", "cosine", "license", "is_file"],
            )

    rows = files.select(F.col("id").cast("long").alias("id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(matched, "id long, path string, cosine double, license string, is_file boolean")


def parent(path: str):
    """The directory of a path ("" at the top)."""
    return F.when(F.instr(F.col(path), "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))


def inherited(found: DataFrame) -> DataFrame:
    """found with license, origin (header, inherited or none) and from_dir, the directory that a file inherits from."""
    found = stored(found.withColumn("dir", parent("path")), "notices")
    # files of one directory may be many: their join with the directory's one row is salted
    salt = F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")
    speaking = found.filter("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "license", "id")).alias("best"))
    speaking = speaking.select(F.col("dir").alias("from_dir"), F.col("best.license").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above))
    dirs = found.filter("dir is not null").select("dir").distinct()
    reach = dirs.select("dir", F.posexplode(above).alias("depth", "from_dir")).join(speaking, "from_dir")
    nearest = reach.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("n")).select("dir", "n.from_dir", "n.given")
    own = F.col("license").isNotNull()
    salted = nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    out = found.withColumn("_salt", salt).join(salted, ["dir", "_salt"], "left")
    return out.select(
        "id", "path", "cosine", "is_file", F.coalesce("license", "given").alias("license"),
        F.when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~own, F.col("from_dir")).alias("from_dir"),
    )


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a made-up tree (source/lang/thousands/id): the table has no paths, so inheritance runs on invented ones."""
    number = F.col("doc_id").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.col("lang"), F.expr("doc_id div 20000").cast("string"), F.expr("doc_id div 2000").cast("string"), number)
    files = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return inherited(notices(files)).withColumnRenamed("id", "doc_id")
