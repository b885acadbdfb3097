"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A vector is made of every line of a file, of every block of adjacent lines (blank ones part blocks) and of the whole, over terms (runs of ASCII letters and digits
and of other bytes beyond ASCII, A-Z lower-cased). Its cosine with each template, a notice, a standard header or a licence text, is taken, and
the best one tells the file's own licence if it reaches the threshold. A whole licence text or header that is all but equal (STRONG) decides before single lines, which near
licences share. A licence is only told where the terms that set it apart from its neighbours (a version, Lesser, Affero) are there and those of the neighbours are not;
a short notice not in a line that says "not".
Weights are 1 + ln((1 + N) / (1 + df)) with the number of lines N and the line counts df of all terms, over all files. As no weight is below 1, a bound of the
cosine without the counts of other terms than the templates' leaves few candidates; only their terms meet the counts of all terms, in a join.
A file without a licence of its own takes that of the nearest directory above
(its own first) which has a licence file (a name of LICENSE_NAMES) with a licence; of several in one directory the least path counts.

Null text has no line. A null path neither inherits nor passes on. Ties go to the line before the block before the whole, and to the first template by name.
Repeated rows are scanned each; very long texts are scanned whole; other columns are left out. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, ship, written
from .words import word_hashes

# The notices by which these licences are stated, standard headers, and licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Of near neighbours: the same notices and headers as they name them.
_GNU = {"GPL-2.0": ("GNU General Public License", "2"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3")}
NEIGHBOURS = [
    {name: TEMPLATES["GPL-3.0"].replace("GNU General Public License", title).replace("version 3", f"version {version}") for name, (title, version) in _GNU.items()},
    {name: HEADERS["GPL-3.0"].replace("GNU General Public License", title).replace("version 3", f"version {version}") for name, (title, version) in _GNU.items()},
    {"BSD-2-Clause": "\n".join(x for x in HEADERS["BSD-3-Clause"].split("\n") if not x.startswith("3."))},
]
#: Terms that a text must have, and must not have, to state a licence.
REQUIRED = {
    "AGPL-3.0": ("affero", "3"), "Apache-2.0": ("apache", "2"), "CC-BY-NC-4.0": ("nc", "4"), "GPL-2.0": ("2",), "GPL-3.0": ("3",), "LGPL-2.1": ("lesser", "2", "1"), "LGPL-3.0": ("lesser", "3"), "MPL-2.0": ("mozilla", "2"),
}
EXCLUDED = {"GPL-2.0": ("affero", "lesser", "library"), "GPL-3.0": ("affero", "lesser", "library"), "LGPL-3.0": ("affero",), "LGPL-2.1": ("affero",), "BSD-2-Clause": ("endorse",)}
#: Words that take a short notice back, unless its own wording has them.
NEGATIONS = ("not", "never", "isn", "wasn", "cannot", "no")
#: Terms of a template from which on it is a text of its own, and the cosine at which such a one decides before any shorter notice.
LONG, STRONG = 40, 0.9
LICENSE_NAMES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
THRESHOLD = 0.6
#: A term in over 1 / HOT of all lines is met by broadcast; there are at most HOT times as many as a line has on average.
HOT = 64
_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 or b == 10 else 32 for b in range(256)).lower()
_UNITS = "array<struct<kind:int,line:int,known:double,dots:array<double>,terms:array<long>,tfs:array<int>>>"
_UNIT_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("line", pa.int32()), ("known", pa.float64()), ("dots", pa.list_(pa.float64())), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))]))


class Templates:
    """Template vectors over their own terms, with weights from the terms' line counts; several may stand for one licence."""

    def __init__(self, *groups: dict[str, str]):
        every = sorted((name, text) for group in groups for name, text in group.items())
        self.names = [name for name, _ in every]
        counts, words = word_hashes([text.encode().translate(_FOLD) for _, text in every])
        self.terms, which = np.unique(words[0], return_inverse=True)
        self.tf = np.zeros((len(every), len(self.terms)))
        np.add.at(self.tf, (np.repeat(np.arange(len(every)), counts), which), 1)
        self.long = counts >= LONG
        tokens = sorted({t for n in self.names for t in (*REQUIRED.get(n, ()), *EXCLUDED.get(n, ()))}) + list(NEGATIONS)
        self.special = word_hashes([t.encode() for t in tokens])[1][0]
        # Of each template the special terms that must and that must not be there.
        self.needs = np.array([[t in REQUIRED.get(n, ()) for t in tokens] for n in self.names], bool).reshape(len(every), -1)
        has = np.isin(self.special, self.terms) & np.array([[h in set(words[0][a - c : a].tolist()) for h in self.special.tolist()] for a, c in zip(np.cumsum(counts), counts)], bool).reshape(len(every), -1)
        denial = np.array([t in NEGATIONS for t in tokens])
        self.bars = np.array([[t in EXCLUDED.get(n, ()) for t in tokens] for n in self.names], bool).reshape(len(every), -1) | (denial & ~has & ~self.long[:, None])

    def stated(self, owner: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Whether each of n texts (a row) has what each template needs, and nothing that bars it."""
        there = np.stack([np.bincount(owner[words == h], minlength=n) > 0 for h in self.special], axis=1).astype(np.float32)
        return (there @ self.needs.T.astype(np.float32) == self.needs.sum(axis=1)) & (there @ self.bars.T.astype(np.float32) == 0)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 if no template has it."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)

    def weigh(self, lines: int, df: np.ndarray) -> None:
        self.weight = 1 + np.log((1 + lines) / (1 + df))
        self.unit = self.tf * self.weight
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)

    def candidates(self, owner: np.ndarray, words: np.ndarray, n: int, threshold: float) -> list[tuple[int, float, list[float], np.ndarray, np.ndarray]]:
        """Of n texts, whose words are given with their owners in order, those that may reach the threshold: number, squared norm of template terms, products with the templates, other terms and their counts."""
        term = self.find(words)
        known = term >= 0
        key, tf = np.unique(owner[known] * len(self.terms) + term[known], return_counts=True)
        of, own = key // len(self.terms), key % len(self.terms)
        value = tf * self.weight[own]
        norm = np.bincount(of, value**2, n)
        dots = np.stack([np.bincount(of, value * u[own], n) for u in self.unit], axis=1) * self.stated(owner, words, n)
        most = dots.max(axis=1) / np.sqrt(np.maximum(norm + np.bincount(owner[~known], minlength=n), 1e-12))
        out = []
        for i in np.flatnonzero(most >= threshold).tolist():
            a, b = np.searchsorted(owner, [i, i + 1])
            terms, tfs = np.unique(words[a:b][~known[a:b]], return_counts=True)
            out.append((i, float(norm[i]), dots[i].tolist(), terms.view(np.int64), tfs))
        return out


def scan_files(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For `files` (file_id, path, text): file_id, path, own (licence told by the text), similarity (null below the threshold), line (where the match begins, from 0; null: the whole), inherited_from (path), license."""
    spark = files.sparkSession
    ship(spark)
    rows = files.select(F.col("file_id").cast("long"), F.col("path").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    known = Templates(templates) if templates else Templates(TEMPLATES, HEADERS, *NEIGHBOURS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = 0
        for whole in batches:
            for batch in by_bytes(whole, limit=1 << 23):
                counts, words = word_hashes([x for t in batch.column("text").to_pylist() for x in t.translate(_FOLD).split(b"\n")])
                lines += int((counts > 0).sum())
                value, number = np.unique(words[0], return_inverse=True)
                key = np.unique(np.repeat(np.arange(len(counts)), counts) * max(len(value), 1) + number)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(key % max(len(value), 1), minlength=len(value)).astype(np.int64))], ["term", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([lines], pa.int64())], ["term", "df"])

    # The row without a term holds the number of lines.
    counted = written(rows.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    lines = counted.filter("term is null").agg(F.sum("df")).first()[0] or 0
    df = np.zeros(len(known.terms))
    for r in counted.filter(F.col("term").isin(known.terms.view(np.int64).tolist())).collect():
        df[known.find(np.array([r["term"]], np.int64).view(np.uint64))[0]] = r["df"]
    known.weigh(lines, df)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                split = [t.translate(_FOLD).split(b"\n") for t in batch.column("text").to_pylist()]
                counts, words = word_hashes([x for s in split for x in s])
                sizes = np.array([len(s) for s in split])
                file = np.repeat(np.arange(len(split)), sizes)
                within = np.arange(len(file)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # A block begins at a line with terms after one without, or at the file's first.
                blank = counts == 0
                begins = ~blank & np.append(True, blank[:-1] | (file[1:] != file[:-1]))
                block = np.maximum(np.cumsum(begins) - 1, 0)
                heads = np.flatnonzero(begins)
                out: list[list[dict]] = [[] for _ in split]
                for kind, (unit, of, line) in enumerate(((np.arange(len(counts)), file, within), (block, file[heads], within[heads]), (file, np.arange(len(split)), None))):
                    for i, norm, dots, terms, tfs in known.candidates(np.repeat(unit, counts), words[0], len(of), threshold) if len(of) else []:
                        out[of[i]].append({"kind": kind, "line": None if line is None else int(line[i]), "known": norm, "dots": dots, "terms": terms.tolist(), "tfs": tfs.tolist()})
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("path"), pa.array(out, _UNIT_TYPE)], ["file_id", "path", "units"])

    found = written(rows.mapInArrow(match, f"file_id long, path string, units {_UNITS}").withColumn("uid", F.monotonically_increasing_id()), "candidates")
    units = found.filter(F.size("units") > 0).select("uid", F.posexplode("units").alias("u", "unit"))
    words = units.select("uid", "u", F.explode(F.arrays_zip("unit.terms", "unit.tfs")).alias("w")).select("uid", "u", F.col("w.terms").alias("term"), F.col("w.tfs").alias("tf"))
    hot = F.broadcast(counted.filter(F.col("term").isNotNull() & (F.col("df") > lines / HOT)))
    met = words.join(hot, "term").unionByName(words.join(hot, "term", "left_anti").join(counted, "term"))
    weight = F.col("tf") * (1 + F.log((1 + F.lit(float(lines))) / (1 + F.col("df"))))
    norms = met.groupBy("uid", "u").agg(F.sum(weight * weight).alias("other"))
    norm = F.sqrt(F.col("unit.known") + F.coalesce("other", F.lit(0.0)))
    long = F.array(*[F.lit(bool(x)) for x in known.long])
    strong = lambda x, k: F.get(long, k.cast("int")) & (x / norm >= STRONG)
    best = F.array_max(F.transform("unit.dots", lambda x, k: F.struct(strong(x, k).alias("strong"), F.round(x / norm, 12).alias("cos"), (-F.col("unit.kind")).alias("kind"), (-k).alias("k"), F.col("unit.line").alias("line"))))
    told = units.join(norms, ["uid", "u"], "left").groupBy("uid").agg(F.max(best).alias("best")).filter(F.col("best.cos") >= threshold)
    told = told.select("uid", F.element_at(F.array(*map(F.lit, known.names)), (1 - F.col("best.k")).cast("int")).alias("own"), F.col("best.cos").alias("similarity"), F.col("best.line").alias("line"))
    found = written(found.select("uid", "file_id", "path").join(told, "uid", "left").drop("uid"), "found")
    found = found.withColumn("dir", F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)))")).withColumn("name", F.substring_index("path", "/", -1))
    licensed = found.filter(F.col("own").isNotNull() & F.col("name").isin(*LICENSE_NAMES)).groupBy("dir").agg(F.min_by(F.struct("path", "own"), F.struct("path", "file_id")).alias("from"))
    # Directories are few beside files; each is led to its nearest licensed ancestor once.
    parts = F.split("dir", "/")
    above = found.filter("path is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, 1, k), F.lit("")))).alias("up"))
    nearest = above.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("from", F.length("up")).alias("from"))
    return found.join(nearest, "dir", "left").select(
        "file_id", "path", "own", "similarity", "line",
        F.when(F.col("own").isNull(), F.col("from.path")).alias("inherited_from"),
        F.coalesce("own", "from.own").alias("license"),
    )
