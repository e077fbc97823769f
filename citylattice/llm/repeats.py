"""Removal of every byte that a ``LENGTH``-byte string which also starts elsewhere covers, over all documents.

Repeated strings are found by prefix polynomial hashes. Every window of ``LENGTH`` bytes has an anchor: its least
``GRAM``-byte hash, the leftmost of equal ones. Equal windows have the same anchor at the same offset, and the windows of
one anchor are consecutive, so that an anchor with its whole context stands for up to ``LENGTH - GRAM + 1`` windows.

1. Anchors are counted by hash and by context over all documents. An anchor that occurs once settles its windows: they
   occur once. A context that occurs twice settles its windows too: they are repeated.
2. What is left are contexts that occur once while their anchor occurs elsewhere, at the borders of repeated passages.
   These, and one holder of each repeated context of the same anchor, meet by anchor, and their windows are compared by
   122 bits: two polynomial hashes modulo 2^61 - 1 with independent bases, the second one verifying the first. Windows are sorted by
   hash, not compared in pairs. The contexts of an anchor that has more than ``CHUNK`` of them are split, and their
   windows also meet by hash over all tasks.

No group has to fit into a task. A filter of fixed size says which anchors can be repeated, so that the second reading
gives few rows; it never decides.

A document is known by its id and the hash of its text, so rows that repeat both share their result and count as two; their
places are listed once.
Null and empty texts have no bytes. Texts shorter than ``LENGTH`` keep all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate, session
from citylattice.session import cut

LENGTH, GRAM = 200, 40
FILTER_BITS = 26
#: Contexts of one anchor that are compared in one group, and contexts that are compared in one go.
CHUNK, WORK = 16384, 4096
U64 = np.uint64


def anchors(data: np.ndarray, offs: np.ndarray):
    """Anchors of the texts in a buffer: first and last window of each, its hash, its context's hash, and its text."""
    empty = np.zeros(0, np.int64)
    span = LENGTH - GRAM + 1
    n = len(data) - GRAM + 1
    if n < span:
        return empty, empty, empty.view(U64), empty.view(U64), empty
    prefix = K.FIRST.prefix(data)
    hashes = K.mix(K.FIRST.windows(prefix, GRAM))
    low = U64(max(1, int(n).bit_length()))
    key = hashes >> low << low | np.arange(n, dtype=U64)  # the place breaks ties, leftmost first
    pad = -n % span
    blocks = np.concatenate([key, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & ((U64(1) << low) - U64(1))
    text = np.searchsorted(offs, np.arange(windows), "right") - 1
    valid = np.flatnonzero(np.arange(windows) + LENGTH <= offs[text + 1])
    if not len(valid):
        return empty, empty, empty.view(U64), empty.view(U64), empty
    mine = least[valid].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    first, last = valid[new], valid[np.append(new[1:] - 1, len(valid) - 1)]
    anchor = mine[new]
    context = K.mix(K.SECOND.spans(K.SECOND.prefix(data), first, last + LENGTH) ^ K.mix((anchor - first).astype(U64)) ^ K.mix((last - first).astype(U64) + U64(1 << 20)))
    return first, last, hashes[anchor], context, text[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(batches):
    """Anchor and context hashes of a batch with their numbers."""
    for batch in batches:
        found = [anchors(data, offs)[2:4] for _, _, data, offs in K.slices(batch.column(0))]
        a, c = (np.concatenate(x) if x else np.zeros(0, U64) for x in (zip(*found) if found else ((), ())))
        both, n = np.unique(np.stack([a, c], axis=1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), U64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(both[:, 0])), _signed(np.ascontiguousarray(both[:, 1])), pa.array(n.astype(np.int64))], names=["a", "c", "n"])


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit set of fixed size over a column ``a`` of hashes."""
    at = F.call_function("shiftrightunsigned", F.col("a"), F.lit(64 - FILTER_BITS))
    words = hashes.select((F.floor(at / 32)).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    held[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return held


def _unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows of a batch (id, text hash and so on) that are no repetition of a row seen before."""
    keep = np.ones(batch.num_rows, dtype=bool)
    for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        keep[i] = row not in seen
        seen.add(row)
    return batch if keep.all() else batch.filter(pa.array(keep))


def _occurrences(bits: np.ndarray):
    def run(batches):
        seen = set()
        for batch in batches:
            batch, rows, parts = _unseen(batch, seen), [], []
            for lo, _, data, offs in K.slices(batch.column(2)):
                first, last, a, c, text = anchors(data, offs)
                at = a >> U64(64 - FILTER_BITS)
                keep = (bits[(at >> U64(5)).astype(np.int64)] >> (at & U64(31)).astype(np.uint32)) & 1 == 1
                text = text[keep]
                rows.append(text + lo)
                parts.append((a[keep], c[keep], (first[keep] - offs[text]).astype(np.int32), (last[keep] - offs[text]).astype(np.int32)))
            if rows:
                where = pa.array(np.concatenate(rows))
                a, c, first, last = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), _signed(a), _signed(c), pa.array(first), pa.array(last)], names=["id", "th", "a", "c", "first", "last"])

    return run


def _contexts(batches):
    """The bytes under the windows of each range of a text."""
    seen = set()
    for batch in batches:
        batch = _unseen(batch, seen)
        ids, th, column, ranges = (batch.column(i) for i in range(4))
        data, offs = K.text_buffers(column)
        counts = np.diff(ranges.offsets.to_numpy())
        rows, inner = np.repeat(np.arange(batch.num_rows), counts), ranges.flatten()
        first, last = inner.field("first").to_numpy(), inner.field("last").to_numpy()
        size = (last - first + LENGTH).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - (offs[rows] + first), size)
        raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])
        yield pa.RecordBatch.from_arrays([inner.field("a"), inner.field("chunk"), inner.field("chunks"), ids.take(pa.array(rows)), th.take(pa.array(rows)), inner.field("first"), inner.field("open"), raw], names=CONTEXT.names)


CONTEXT = T.StructType([T.StructField("a", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("chunks", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("raw", T.BinaryType())])


def _hashed(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row, and both hashes of every window of a binary column."""
    data, offs = K.text_buffers(raw)
    n = np.diff(offs) - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = start + offs[row]
    return row, start, K.mix(K.FIRST.spans(K.FIRST.prefix(data), at, at + LENGTH)), K.mix(K.SECOND.spans(K.SECOND.prefix(data), at, at + LENGTH))


def _marked_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs of repeated windows in the open contexts of a batch; what is equal here is equal anywhere."""
    row, start, h1, h2 = _hashed(batch.column(7))
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    twice = np.zeros(len(row), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= batch.column(6).to_numpy(zero_copy_only=False)[row]
    at = np.flatnonzero(twice)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]) if len(at) else np.zeros(0, bool)
    heads = at[new]
    tails = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
    where, base = pa.array(row[heads]), batch.column(5).to_numpy()[row[heads]]
    return pa.RecordBatch.from_arrays([batch.column(3).take(where), batch.column(4).take(where), pa.array((base + start[heads]).astype(np.int32)), pa.array((base + start[tails] + LENGTH).astype(np.int32))], names=["id", "th", "first", "end"])


def _compared(batches):
    """Contexts that come sorted by anchor and chunk, compared within each; a group is never cut in two."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held and size >= WORK:
            last = held[-1]
            apart = np.flatnonzero((a != last.column(0)[-1].as_py()) | (chunk != last.column(1)[-1].as_py()))
            cut_at = int(apart[0]) if len(apart) else batch.num_rows
            held.append(batch.slice(0, cut_at))
            if cut_at < batch.num_rows:
                yield _marked_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
            batch = batch.slice(cut_at)
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield _marked_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _spread(batches):
    """Every window of contexts with its place and hashes."""
    for batch in batches:
        row, start, h1, h2 = _hashed(batch.column(7))
        where, base = pa.array(row), batch.column(5).to_numpy()[row]
        yield pa.RecordBatch.from_arrays([batch.column(3).take(where), batch.column(4).take(where), pa.array((base + start).astype(np.int32)), batch.column(6).take(where), _signed(h1), _signed(h2)], names=["id", "th", "first", "open", "h1", "h2"])


FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _merged(firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of ranges; ranges that touch are one run."""
    order = np.argsort(firsts, kind="stable")
    s, e = firsts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:] - 1, len(s) - 1)]


def _kept(raw: bytes, firsts, ends) -> tuple[bytes, int]:
    s, e = _merged(np.asarray(firsts, np.int64), np.asarray(ends, np.int64))
    whole = memoryview(raw)
    return b"".join(whole[a:b] for a, b in zip([0, *e], [*s, len(raw)])), len(s)


def _summed():
    def compute(column, firsts, ends):
        out = ([], [], [], [])
        for lo, hi, data, offs in K.slices(column):
            for i in range(lo, hi):
                raw, runs = data[offs[i - lo] : offs[i - lo + 1]].tobytes(), 0
                kept = raw
                if firsts[i].is_valid and len(firsts[i]):
                    kept, runs = _kept(raw, firsts[i].values.to_numpy(), ends[i].values.to_numpy())
                for x, v in zip(out, (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())):
                    x.append(v)
        return out

    return compute


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, th, firsts, ends): byte ranges that repeated strings cover, for each document that has any; ``th`` is
    xxhash64 of the text. Ranges overlap and are not ordered."""
    session(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH)
    counted = given.select("text").mapInArrow(_counted, "a long, c long, n long").repartition("a")
    contexts = counted.groupBy("a", "c").agg(F.sum("n").alias("n"))
    often = contexts.groupBy("a").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1").select("a", "kinds")
    known = cut(contexts.join(often, "a"))
    bits = _filter_of(known.select("a"))
    seen = given.mapInArrow(_occurrences(bits), "id long, th long, a long, c long, first int, last int")
    found = cut(seen.join(known, ["a", "c"]).select("id", "th", "a", "c", "first", "last", "kinds", (F.col("n") > 1).alias("settled")))
    # to be compared: contexts that occur once, and one holder of each other context of the same anchor
    mixed = found.where("kinds > 1")
    place = F.struct("id", "th", "first", "last")
    held = mixed.where("settled").groupBy("a", "c", "kinds").agg(F.min(place).alias("m")).select("m.*", "a", "c", "kinds", F.lit(False).alias("open"))
    asked = mixed.where("not settled").select("id", "th", "first", "last", "a", "c", "kinds", F.lit(True).alias("open")).unionByName(held)
    chunks = F.ceil(F.col("kinds") / CHUNK).cast("int")
    asked = asked.withColumn("chunks", chunks).withColumn("chunk", F.pmod("c", F.col("chunks")).cast("int"))
    ranges = cut(asked.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "open", "a", "chunk", "chunks")).alias("ranges")))
    same = given["id"].eqNullSafe(ranges["id"]) & (given["th"] == ranges["th"])
    cuts = given.join(ranges, same).select(given["id"], given["th"], "text", "ranges").mapInArrow(_contexts, CONTEXT)
    near = cut(cuts)
    runs = "id long, th long, first int, end int"
    more = near.repartition("a", "chunk").sortWithinPartitions("a", "chunk").mapInArrow(_compared, runs)
    marks = found.where("settled").select("id", "th", "first", (F.col("last") + LENGTH).alias("end")).unionByName(more)
    wide = near.where("chunks > 1")
    if not wide.isEmpty():  # groups beyond one chunk: their windows meet by hash
        windows = cut(wide.mapInArrow(_spread, "id long, th long, first int, open boolean, h1 long, h2 long"))
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        marks = marks.unionByName(windows.where("open").join(twice, ["h1", "h2"]).select("id", "th", "first", (F.col("first") + LENGTH).alias("end")))
    # rows that repeat id and text are one here, so a list is as long as its text allows
    return marks.distinct().groupBy("id", "th").agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))


def _marked(docs: DataFrame, text: str, doc_id: str, kept: list[str]) -> DataFrame:
    marks = cut(repeated(docs, text, doc_id)).select(*[F.col(c).alias(f"__{c}") for c in ("id", "th", "firsts", "ends")])
    rows = docs.select(*[F.col(c) for c in kept], F.col(doc_id).alias("__doc"), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__hash"))
    return rows.join(marks, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left").drop("__doc", "__hash", "__id", "__th")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    marked = _marked(docs, "text", "doc_id", ["doc_id"])
    return annotate(marked, ["__text", "__firsts", "__ends"], _summed, FIELDS, drop=["__text", "__firsts", "__ends"])


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the repeated bytes; UTF-8 sequences that a cut breaks are dropped with it. Null stays null."""
    marked = _marked(docs, text, doc_id, [c for c in docs.columns if c != text])

    def make():
        def compute(column, firsts, ends):
            out = []
            for x, s, e in zip(column, firsts, ends):
                if not s.is_valid or not len(s):
                    out.append(x.as_py())
                else:
                    out.append(_kept(x.as_buffer().to_pybytes(), s.values.to_numpy(), e.values.to_numpy())[0].decode("utf-8", "ignore"))
            return [out]

        return compute

    out = annotate(marked, ["__text", "__firsts", "__ends"], make, T.StructType([T.StructField(text, T.StringType())]), drop=["__text", "__firsts", "__ends"])
    return out.select(*docs.columns)
