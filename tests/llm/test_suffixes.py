"""The suffix sort against Python's, and its repeated strings against the operator."""

import hashlib

import numpy as np
import pyarrow as pa
from test_repeats import cases

from citylattice.llm import kernels as K
from citylattice.llm.repeats import LENGTH, report
from citylattice.llm.suffixes import Suffixes, covered


def test_order():
    texts = [b"banana", b"", b"ananas", b"bananabanana", b"a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    got = Suffixes(data, stop, 100).order(np.arange(len(data)))
    assert got.tolist() == sorted(range(len(data)), key=lambda i: (data[i : stop[i]].tobytes(), i))


def test_same_repeats_as_the_operator(spark):
    rows = [r for r in cases() if r[0] is not None and (not r[1] or len(r[1]) < 2000)]
    got = sorted(tuple(r) for r in report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    data, offs = K.text_buffers(pa.array([t for _, t in rows]))
    hit, want = covered(data, offs, LENGTH), []
    for n, (d, _) in enumerate(rows):
        part, gone = data[offs[n] : offs[n + 1]], hit[offs[n] : offs[n + 1]]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        want.append((d, len(part), int(gone.sum()), runs, hashlib.sha256(part[~gone].tobytes()).hexdigest()))
    assert got == sorted(want)
