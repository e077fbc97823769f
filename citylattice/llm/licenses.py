"""Licence scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance along directories.

A file's lines, the file as a whole, and every run of as many words as a template has are compared with the templates, so a
notice may be wrapped over lines, commented out or stand in other prose. The templates hold notices, standard headers and
whole short licences; the long licences hold their own standard header or opening, which is found in them. Words are runs of letters and digits, lower
case in ASCII; a line's vector is its word counts times inverse document frequencies, which are counted over all files for
the words of the templates; any other word weighs as one that no file has. The best template decides, if its cosine is
``CLOSE`` or more; ties go to the template that is listed first. Lines and runs that can't reach it are passed over by an exact
bound (the dot product is linear in the counts, the norm at least that of single counts).

A licence file is one with a usual name, or one of whose words at least ``MOSTLY`` stand in lines or runs that match. It speaks for
its directory. A file without a licence of its own inherits from the nearest ancestor directory that has one; several
licence files of a directory are settled by score and then by path. Directories meet by path: each distinct directory
looks at its own ancestors only, and files then look up their directory.

Null and empty texts have no licence of their own but inherit. A null path belongs to no directory. Repeated rows get a row
each; columns of the input that have the name of a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate, session

CLOSE, MOSTLY = 0.8, 0.5
NAMES = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)[^/]*$"

_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Identifier and wording of each template.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License; permission is granted free of charge to any person obtaining a copy."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license; redistribution and use in source and binary forms are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MIT", _MIT),
    ("MIT", _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    *[(f"{kind}GPL-{version}", _GNU.format(what="program", kind=name, version=number)) for kind, name, version, number in (("", "", "2.0", "2"), ("", "", "3.0", "3"), ("L", "Lesser ", "2.1", "2.1"), ("L", "Lesser ", "3.0", "3"), ("A", "Affero ", "3.0", "3"))],
    ("LGPL-2.1", _GNU.format(what="library", kind="Lesser ", version="2.1")),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("BSD-3-Clause", f"{_BSD} {_THIRD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_THIRD}"),
    # whoever the holder is; before the two clauses, which the three contain
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # the identifiers of one-line headers
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0")],
    *[(name, f"SPDX-License-Identifier: {name}-{end}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")],
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship and/or a database (each, a \"Work\")."),
]


def _words(column: pa.Array):
    """Slices as (first row, end row, bytes, word starts, words' offsets by text, hashes)."""
    for lo, hi, data, offs in K.slices(column):
        low = K.LOWER[data]
        start, end, by_text = K.words(low, offs, K.ALNUM)
        yield lo, hi, low, start, by_text, K.word_hashes(low, start, end)


class Templates:
    """Vocabulary and unit vectors of templates under document frequencies."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        (_, _, _, _, by_text, h), *_ = list(_words(pa.array([t for _, t in templates]))) or [(0, 0, None, None, np.zeros(1, int), np.zeros(0, np.uint64))]
        self.vocabulary = np.unique(h)
        self.counts = np.zeros((len(templates), len(self.vocabulary)))
        for i in range(len(templates)):
            np.add.at(self.counts[i], np.searchsorted(self.vocabulary, h[by_text[i] : by_text[i + 1]]), 1)

    def index(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, or its size."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def weigh(self, frequency: np.ndarray, n: int) -> "Templates":
        """Sets weights from the number of files that hold each word, of n."""
        self.idf = np.log((n + 1.0) / (np.append(frequency, 0) + 1.0)) + 1.0
        own = self.counts * self.idf[:-1]
        self.unit = own / np.linalg.norm(own, axis=1, keepdims=True)
        # what one use of a word adds to the dot product with each template; nothing for other words
        self.adds = np.vstack([(self.unit * self.idf[:-1]).T, np.zeros(len(self.names))])
        self.rows = np.ascontiguousarray(self.adds.T)
        # words of each template without any of which no list of words can reach ``CLOSE``
        self.needed = np.zeros((len(self.names), len(self.vocabulary) + 1), dtype=bool)
        for t, unit in enumerate(self.unit):
            order = np.argsort(unit, kind="stable")
            self.needed[t, order[np.cumsum(unit[order] ** 2) >= (CLOSE - 1e-6) ** 2]] = True
        return self

    def cosines(self, h: np.ndarray) -> np.ndarray:
        """Exact cosines of one list of words."""
        distinct, times = np.unique(h, return_counts=True)
        at = self.index(distinct)
        norm = np.sqrt(((times * self.idf[at]) ** 2).sum())
        return (times[:, None] * self.adds[at]).sum(axis=0) / norm if len(h) else np.zeros(len(self.names))

    def best(self, at: np.ndarray, h: np.ndarray, heads: np.ndarray, ends: np.ndarray):
        """(segment, template, cosine) of the segments h[head:end] that reach ``CLOSE``."""
        weight = np.concatenate([[0.0], np.cumsum(self.idf[at] ** 2)])
        dots = np.zeros((len(heads), len(self.names)))
        known = np.flatnonzero(at < len(self.vocabulary))
        if len(known):
            owner = np.searchsorted(heads, known, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            dots[owner[first]] = np.add.reduceat(self.adds[at[known]], first, axis=0)
        least = np.sqrt(np.maximum(weight[ends] - weight[heads], 1e-12))
        for s in np.flatnonzero(dots.max(axis=1) >= (CLOSE - 1e-9) * least):
            exact = self.cosines(h[heads[s] : ends[s]])
            if exact.max() >= CLOSE:
                yield int(s), int(exact.argmax()), float(exact.max())

    def runs(self, at: np.ndarray, h: np.ndarray, text: np.ndarray):
        """(start, end, template, cosine) of the runs of as many words as a template has, inside a text, that reach
        ``CLOSE`` with it."""
        weight = np.concatenate([[0.0], np.cumsum(self.idf[at] ** 2)])
        known = np.flatnonzero(at < len(self.vocabulary))
        for t, n in enumerate(self.counts.sum(axis=1).astype(int)):
            held = known[self.needed[t][at[known]]]
            if n > len(h) or not len(held):
                continue
            # starts of runs that hold a needed word
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(held - n + 1, 0), 1)
            np.add.at(edge, held + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[: len(h) - n + 1]) > 0)
            sums = np.concatenate([[0.0], np.cumsum(self.rows[t][at])])
            dots = sums[starts + n] - sums[starts]
            likely = (dots * dots >= (CLOSE * CLOSE - 1e-6) * (weight[starts + n] - weight[starts])) & (text[starts + n - 1] == text[starts])
            for s in starts[likely]:
                exact = self.cosines(h[s : s + n])[t]
                if exact >= CLOSE:
                    yield int(s), int(s + n), t, float(exact)


def _frequencies(templates: Templates):
    def run(batches):
        total = np.zeros(len(templates.vocabulary) + 1, np.int64)
        for batch in batches:
            for lo, hi, _, _, by_text, h in _words(batch.column(0)):
                at = templates.index(h)
                text = np.repeat(np.arange(hi - lo), np.diff(by_text))
                known = at < len(templates.vocabulary)
                pairs = np.unique(text[known] * np.int64(len(total)) + at[known])
                total += np.bincount(pairs % len(total), minlength=len(total))
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["word", "n"])

    return run


FIELDS = T.StructType([T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField("licensed_share", T.DoubleType())])


def _scanner(templates: Templates):
    def compute(column):
        n = len(column)
        names, scores, shares = [None] * n, np.zeros(n), np.zeros(n)
        for lo, hi, low, start, by_text, h in _words(column):
            at = templates.index(h)
            line = np.cumsum(low == 0x0A)[start] if len(start) else start
            text = np.repeat(np.arange(hi - lo), np.diff(by_text))
            heads = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])])) if len(h) else start
            ends = np.append(heads[1:], len(h))
            matched = np.zeros(len(h) + 1, np.int64)
            found = []
            parts = [(heads[s], ends[s], t, c) for s, t, c in templates.best(at, h, heads, ends)] + list(templates.runs(at, h, text))
            for a, b, t, c in parts:
                matched[a] += 1
                matched[b] -= 1
                found.append((int(text[a]), t, c, b - a))
            # words of each text that stand in what matches
            matched = np.concatenate([[0], np.cumsum(np.cumsum(matched[:-1]) > 0)])[by_text]
            whole = np.flatnonzero(np.diff(by_text))
            found += [(int(whole[s]), t, c, 0) for s, t, c in templates.best(at, h, by_text[:-1][whole], by_text[1:][whole])]
            ranked = {}
            for i, t, c, _ in found:
                ranked[i] = max(ranked.get(i, (0.0, 0)), (round(c, 12), -t))
            for i, (c, t) in ranked.items():
                names[lo + i], scores[lo + i] = templates.names[-t], c
                # a text that matches as a whole counts as all licence
                shares[lo + i] = max((matched[i + 1] - matched[i]) / (by_text[i + 1] - by_text[i]), 1.0 if any(x[0] == i and not x[3] for x in found) else 0.0)
        return names, scores, shares

    return compute


def directory(path: Column) -> Column:
    """All of a path up to its last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, keep_text: bool = True) -> DataFrame:
    """``files`` with own_license, own_score, licensed_share, license (own or inherited) and license_from (own, a
    directory, or null)."""
    session(files.sparkSession)
    given = files.select(*[c for c in files.columns if c not in ("own_license", "own_score", "licensed_share", "license", "license_from")])
    known = Templates(templates)
    sums = given.select(F.col(text).cast("string")).mapInArrow(_frequencies(known), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(known.vocabulary) + 1, np.int64)
    n[sums["word"].to_numpy()] = sums["n"].to_numpy()
    known.weigh(n[:-1], int(n[-1]))
    own = annotate(given, [text], lambda: _scanner(known), FIELDS, drop=() if keep_text else [text])
    p = F.col(path)
    speaks = own.where(p.isNotNull() & F.col("own_license").isNotNull() & (p.rlike(NAMES) | (F.col("licensed_share") >= MOSTLY)))
    said = speaks.groupBy(directory(p).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), p.alias("p"), F.col("own_license").alias("l"))).alias("b")).select("dir", F.col("b.l").alias("l"))
    dirs = given.where(p.isNotNull()).select(directory(p).alias("home")).distinct()
    steps = F.split("home", "/")
    # the directory itself, its ancestors, and the top
    above = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).withColumn("dir", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(said, "dir").groupBy("home").agg(F.max_by(F.struct("l", "dir"), "depth").alias("near")).select(F.col("home").alias("__home"), F.col("near.l").alias("__l"), F.col("near.dir").alias("__dir"))
    joined = own.join(nearest, directory(p) == F.col("__home"), "left")
    mine = F.col("own_license").isNotNull()
    return joined.withColumns({"license": F.coalesce("own_license", "__l"), "license_from": F.when(mine, F.lit("own")).otherwise(F.col("__dir"))}).drop("__home", "__l", "__dir")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, taken as the file source/thousand of the id/id: doc_id, path, own_license, own_score,
    license, license_from. A null source is the directory none."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    rows = scan(docs.select("doc_id", "text", path.alias("path")), keep_text=False)
    return rows.select("doc_id", "path", "own_license", "own_score", "license", "license_from")
