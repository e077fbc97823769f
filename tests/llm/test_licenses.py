"""Cosines and inheritance against plain Python, and edge cases."""

import math
import re
from collections import Counter

import pytest

from citylattice.llm.licenses import CLOSE, TEMPLATES, report, scan


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts):
    vocabulary = {w for _, t in TEMPLATES for w in words(t)}
    df = Counter(w for t in texts for w in set(words(t)) & vocabulary)
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, vector(words(t))) for n, t in TEMPLATES]
    out = []
    for t in texts:
        best = (0.0, 0)
        for part in [*(t or "").split("\n"), t]:
            v = vector(words(part))
            for i, (_, k) in enumerate(known):
                c = sum(x * k.get(w, 0) for w, x in v.items()) / (norm(v) * norm(k)) if v else 0
                if c >= CLOSE:
                    best = max(best, (round(c, 12), -i))
        out.append((TEMPLATES[-best[1]][0], best[0]) if best[0] else (None, 0.0))
    return out


FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/x.txt", "text"),
    ("a/b/c/y.txt", None),
    ("a/b/z.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore code"),
    ("a/b/c/COPYING.md", "GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/e.txt", ""),
    ("other/f.txt", "the license of nothing"),
    ("ab/g.txt", "not below a"),
    ("top.txt", "x"),
    (None, "Licensed under CC BY-NC 4.0."),
    ("a/long.txt", "word " * 60_000 + "\nReleased under the MIT License."),
    ("a/x.txt", "text"),
    ("n/small.txt", "Released under the MIT License.\nfoo"),
    ("n/o.txt", "y"),
]


def test_files(spark):
    df = spark.createDataFrame([(p, t, 1, "z") for p, t in FILES], "path string, text string, own_score int, license string")
    got = scan(df).collect()
    assert len(got) == len(FILES)
    want = {p: w for (p, _), w in zip(FILES, brute([t for _, t in FILES]))}
    for r in got:
        assert r.own_license == want[r.path][0] and r.own_score == pytest.approx(want[r.path][1])
    found = {r.path: (r.license, r.license_from) for r in got}
    assert found["a/x.txt"] == ("MIT", "a") and found["a/b/c/y.txt"] == ("GPL-3.0", "a/b/c")
    assert found["a/b/z.txt"] == ("Apache-2.0", "own") and found["a/b/c/d/e.txt"] == ("GPL-3.0", "a/b/c")
    assert found["ab/g.txt"] == found["other/f.txt"] == found["top.txt"] == (None, None)
    assert found[None] == ("CC-BY-NC-4.0", "own") and found["a/long.txt"] == ("MIT", "own") and found["n/o.txt"] == ("MIT", "n")


def test_top_directory_and_empty(spark):
    df = spark.createDataFrame([("LICENSE", "Licensed under CC BY 4.0."), ("deep/er/file", "x")], "path string, text string")
    assert {r.path: r.license for r in scan(df).collect()} == {"LICENSE": "CC-BY-4.0", "deep/er/file": "CC-BY-4.0"}
    assert scan(df.limit(0)).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in report(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, (name, score) in zip(rows, brute([r.text for r in rows])):
        assert got[r.doc_id].own_license == name and got[r.doc_id].own_score == pytest.approx(score)
    lines = {"Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."}
    assert all(got[r.doc_id].own_license for r in rows if lines & set(r.text.split("\n")))


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
BSD = """/* Copyright (c) 2001, Somebody Else.  All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *  1. Redistributions of source code must retain the above copyright notice,
 *     this list of conditions and the following disclaimer.
 *  2. Redistributions in binary form must reproduce the above copyright notice,
 *     this list of conditions and the following disclaimer in the documentation
 *     and/or other materials provided with the distribution.
 */
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_headers_prose_and_whole_licences(spark):
    code = "\n".join(f"value{i} = other{i} + {i}" for i in range(200))
    shared = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    cases = [(GPL + code, "GPL-3.0"), (GPL.replace("version 3", "version 2") + code, "GPL-2.0"), (GPL.replace("GNU General", "GNU Affero General") + code, "AGPL-3.0"), (BSD + code, "BSD-2-Clause"), (MPL + code, "MPL-2.0")]
    cases += [("We met in spring and then, as all of it is Released under the MIT License. nobody asked where the rest had gone", "MIT"), (code, None)]
    cases += [(open(f"/usr/share/common-licenses/{f}").read(), want) for f, want in shared.items()]
    files = spark.createDataFrame([(f"d{i}/x", t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {r.path: r.own_license for r in scan(files).collect()}
    assert [got[f"d{i}/x"] for i in range(len(cases))] == [want for _, want in cases]


def test_identifiers(spark):
    lines = {"MIT": "// SPDX-License-Identifier: MIT", "Apache-2.0": "# spdx-license-identifier: Apache-2.0", "GPL-3.0": "/* SPDX-License-Identifier: GPL-3.0-or-later */", "LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1-only"}
    df = spark.createDataFrame([(n, f"first line\n{t}\nint main() {{}}") for n, t in lines.items()], "path string, text string")
    assert {r.path: r.own_license for r in scan(df).collect()} == {n: n for n in lines}
