"""Near-duplicates by MinHash: universal hash minima, banding, verification on full sets, connected components.

A document's set is its distinct shingles of ``SHINGLE`` lower-cased words; fewer words count as one shingle, no words
as the empty set, which is linked with nothing. Documents of equal sets form a class with one set of minima and a number.
``BANDS`` bands of ``ROWS`` minima bring classes together: two sets of similarity s share no band with probability
(1 - s^ROWS)^BANDS, which is 4e-7 at 0.85.

Within a band no pairs are listed. In each of a few rounds, every class of a bucket that is not yet connected with the
bucket's heads is compared with them; the first head is the class with most documents. What is connected by then needs no
further comparison. Buckets that still hold more than ``LARGE`` classes are dealt anew by ``MORE`` further bands of
``MORE_ROWS`` minima, which a pair of similarity 0.8 misses with probability 1e-5 and unlike texts hardly ever share. The
classes that stay apart are compared with the rest of their bucket in blocks.

All comparisons begin with sketches, two bits of each of ``SKETCH`` further minima; a pair whose sketches put its similarity
more than ``SLACK`` below the wanted one is passed over, which happens to a pair of similarity 0.85 with probability 1e-5
and to closer ones hardly ever. Blocks have sharp sketches with more minima and less slack, of the same probability. Every
link is confirmed on the full sets. Only classes that share a bucket have sketches and sets made.

Links become components by alternating stars; each round's links are put on the components of the rounds before. A
component carries the least id of its documents. Null ids are larger than others: a component of only such documents has a
null id. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate, session
from citylattice.operators.components import components
from citylattice.session import cut, forget

SHINGLE, BANDS, ROWS = 5, 20, 4
#: Minima of a sketch, and how far below the wanted similarity the one that sketches show may be; the same of sharp ones.
SKETCH, SLACK = 512, 0.09
SHARP, SHARP_SLACK = 2048, 0.045
#: Heads of a bucket in a later round, and rounds, before what is left is compared in blocks.
HEADS, ROUNDS = 2, 1
BLOCK = 512
#: Pairs of a block that are compared at once; comparisons of a task, and the cost of a block beside its comparisons.
AT_ONCE, TASK_WORK, GROUP_COST = 1 << 14, 1 << 24, 20_000
#: Classes of a bucket beyond which it is dealt anew, by so many bands of so many of the sketch's minima.
LARGE, MORE, MORE_ROWS = 2048, 64, 8
#: Bits of the filter that says which documents give their sets; its size is fixed.
FILTER_BITS = 23
U64 = np.uint64

FACTORS = K.seeds(BANDS * ROWS + SHARP, 71) | U64(1)
SHIFTS = K.seeds(BANDS * ROWS + SHARP, 72)
#: The minima of bands, of sketches, and of sharp ones, which begin like the others.
OF_BANDS, OF_SKETCH, OF_SHARP = slice(0, BANDS * ROWS), slice(BANDS * ROWS, BANDS * ROWS + SKETCH), slice(BANDS * ROWS, None)


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, data, offs in K.slices(column):
        low = K.LOWER[data]
        start, end, by_text = K.words(low, offs, K.SPACED)
        h = K.word_hashes(low, start, end)
        whole = K.grams(h, SHINGLE)
        for i in range(hi - lo):
            a, b = int(by_text[i]), int(by_text[i + 1])
            if b - a >= SHINGLE:
                yield np.unique(whole[a : b - SHINGLE + 1])
            else:
                yield K.grams(h[a:b], b - a, 60 + b - a) if b > a else h[:0]


def minima(s: np.ndarray, which: slice) -> np.ndarray:
    """High words of a*x+b modulo 2^64, least over the set."""
    a, b = FACTORS[which, None], SHIFTS[which, None]
    out, step = np.full(len(a), np.iinfo(np.uint64).max, dtype=U64), (1 << 17) // len(a)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), step):
            values = a * s[None, lo : lo + step]
            values += b
            np.minimum(out, values.min(axis=1), out=out)
    return (out >> U64(32)).astype(np.uint32)


def class_of(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        first = K.mix(s ^ U64(0x5BD1E995)).sum(dtype=U64) + U64(len(s))
        second = K.mix(s * U64(0x9E3779B97F4A7C15) + U64(17)).sum(dtype=U64)
    return np.array([first, second], dtype=">u8").tobytes()


SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _signed():
    number = K.mix(np.arange(BANDS, dtype=U64))

    def compute(column):
        n, cls, bands = [], [], []
        for s in shingle_sets(column):
            n.append(len(s))
            if len(s):
                cls.append(class_of(s))
                bands.append((K.grams(minima(s, OF_BANDS).astype(U64), ROWS, 81)[::ROWS] ^ number).view(np.int64))
            else:
                cls.append(None)
                bands.append(None)
        return n, cls, bands

    return compute


def _sketch(least: np.ndarray) -> bytes:
    """Two bits of each minimum."""
    return np.packbits(np.unpackbits((least & 3).astype(np.uint8)[:, None], axis=1)[:, 6:]).tobytes()


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity that sketches (rows of 64-bit words) show; unlike sets agree in a quarter of their minima by chance."""
    differ = a ^ b
    differ = (differ | differ >> U64(1)) & U64(0x5555555555555555)
    return 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / (0.75 * 32 * differ.shape[-1])


def _words_of(sketches: pa.Array) -> np.ndarray:
    data, _ = K.text_buffers(sketches)
    return np.ascontiguousarray(data).view(U64).reshape(len(sketches), -1)


def _likely(least: float):
    """Pairs (u, v, ru, rv) of rows (u, v, ru, rv, a, b) whose sketches a and b agree."""

    def run(batches):
        for batch in batches:
            near = _agreeing(_words_of(batch.column(4)), _words_of(batch.column(5))) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    return run


def _wanted_bits(hashes: DataFrame) -> np.ndarray:
    """A bit set of fixed size over a column ``h`` of hashes."""
    at = F.pmod("h", F.lit(1 << FILTER_BITS))
    words = hashes.select((F.floor(at / 32)).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    held[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return held


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(cid, set, sketch, bands) of the classes of ``wanted`` (cid, cls, rep, bands): texts are parsed once more, and only those
    whose text is a class's representative leave Python, once in each task. The filter is a bit set of fixed size."""
    bits = _wanted_bits(wanted.select(F.col("rep").alias("h")))
    hashed = docs.select(F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__rep")).where(F.col("__text").isNotNull())

    def run(batches):
        seen = set()
        for batch in batches:
            rep = batch.column(1).to_numpy()
            where = rep & ((1 << FILTER_BITS) - 1)
            keep = (bits[where >> 5] >> (where & 31).astype(np.uint32)) & 1 == 1
            for i in np.flatnonzero(keep):
                keep[i] = rep[i] not in seen
                seen.add(rep[i])
            part = batch.filter(pa.array(keep))
            if part.num_rows:
                sets = list(shingle_sets(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.binary()), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_sketch(minima(s, OF_SKETCH)) for s in sets], pa.binary())], names=["cls", "rep", "set", "sketch"])

    found = hashed.mapInArrow(run, "cls binary, rep long, set binary, sketch binary")
    one = found.join(wanted, ["cls", "rep"])
    return one.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("set", "sketch", "bands")])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, ru, rv) whose sets have 100 * intersection >= percent * union."""
    with_u = pairs.join(sets.select(F.col("cid").alias("u"), F.col("set").alias("a")), "u")
    both = with_u.join(sets.select(F.col("cid").alias("v"), F.col("set").alias("b")), "v").select("u", "v", "ru", "rv", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5)):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(z) - common))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, PAIRS)


PAIRS = "u long, v long, ru long, rv long"


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct pairs (u, v, ru, rv) of classes (c, d) of different roots (rc, rd), the smaller class first."""
    up = F.col("c") < F.col("d")
    one = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return rows.where("rc <> rd").select(one("c", "d").alias("u"), one("d", "c").alias("v"), one("rc", "rd").alias("ru"), one("rd", "rc").alias("rv")).distinct()


def _with_heads(open_: DataFrame, sets: DataFrame, least: float, step: int) -> DataFrame:
    """Likely pairs of classes and heads of their buckets. ``open_``: key, cid, copies, root."""
    if step == 0:  # the class with most documents; the hash breaks ties
        ranks = [-F.least("copies", F.lit(1 << 14)) * F.lit(1 << 48) + F.pmod(F.xxhash64("cid"), F.lit(1 << 48))]
    else:
        ranks = [F.xxhash64("cid", "key", F.lit(step * HEADS + h)) for h in range(HEADS)]
    first = open_.groupBy("key").agg(*[F.min(r).alias(f"m{h}") for h, r in enumerate(ranks)])
    is_head = F.lit(False)
    for h, r in enumerate(ranks):
        is_head = is_head | (r == F.col(f"m{h}"))
    heads = open_.join(first, "key").where(is_head).select("key", F.col("cid").alias("d"), F.col("root").alias("rd"))
    pairs = _ordered(open_.select("key", F.col("cid").alias("c"), F.col("root").alias("rc")).join(heads, "key"))
    sketch = sets.select("cid", "sketch")
    both = pairs.join(sketch.select(F.col("cid").alias("u"), F.col("sketch").alias("a")), "u").join(sketch.select(F.col("cid").alias("v"), F.col("sketch").alias("b")), "v")
    return both.select("u", "v", "ru", "rv", "a", "b").mapInArrow(_likely(least), PAIRS)


def _apart(rows: DataFrame) -> DataFrame:
    """Rows of buckets whose classes have different roots."""
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rows.join(keys, "key")


def _sharpened(batches):
    """Sharp sketches and further bands of classes (cid, set, bands)."""
    number = K.mix(np.arange(MORE, dtype=U64))
    for batch in batches:
        least = [minima(np.frombuffer(s.as_buffer(), U64), OF_SHARP) for s in batch.column(1)]
        more = [(K.grams(x[: MORE * MORE_ROWS].astype(U64), MORE_ROWS, 82)[::MORE_ROWS] ^ number).view(np.int64) for x in least]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_sketch, least), pa.binary()), batch.column(2), pa.array(more, pa.list_(pa.int64()))], names=["cid", "sketch", "bands", "more"])


def _in_blocks(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs between classes of different roots in a bucket (key, cid, root). Loose classes are those outside the
    bucket's largest root; every block of them meets each chunk of the bucket, and a pair counts in the first band that it
    shares. Large buckets are dealt anew first."""
    rows = open_.select("key", "cid", "root", F.col("key").alias("band"))
    few = sets.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "set", "bands")
    sharp = cut(few.mapInArrow(_sharpened, "cid long, sketch binary, bands array<long>, more array<long>"))
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.join(size, "key")
    again = sized.where(F.col("n") > LARGE).join(sharp.select("cid", "more"), "cid").select("band", "cid", "root", F.posexplode("more").alias("i", "m")).select(F.xxhash64("band", "i", "m").alias("key"), "cid", "root", "band")
    rows = cut(sized.where(F.col("n") <= LARGE).drop("n").unionByName(_apart(again)))
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all")).select("key", F.col("m.root").alias("main"), "all", (F.col("all") - F.col("m.n")).alias("few"))
    chunks, blocks = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil(F.col("few") / BLOCK).cast("int")
    full = rows.join(main, "key").join(sharp.drop("more"), "cid").withColumn("loose", F.col("root") != F.col("main"))
    payload = ("band", "cid", "root", "sketch", "bands")
    left = full.where("loose").select("key", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(True).alias("l"), *payload)
    right = full.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"), F.lit(False).alias("l"), *payload)
    coarse, fine, words = percent / 100 - SLACK, percent / 100 - SHARP_SLACK, SKETCH // 32

    def run(key, table):
        flags, here = table.column("l").to_numpy(), table.column("band")[0].as_py()
        cid, root = table.column("cid").to_numpy(), table.column("root").to_numpy()
        sketch = _words_of(table.column("sketch").combine_chunks())
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        a, b, out = np.flatnonzero(flags), np.flatnonzero(~flags), [np.zeros((0, 4), np.int64)]
        checks = (
            lambda p, q: root[p] != root[q],
            lambda p, q: _agreeing(sketch[p, :words], sketch[q, :words]) >= coarse,
            lambda p, q: _agreeing(sketch[p], sketch[q]) >= fine,
            lambda p, q: bands[p, (bands[p] == bands[q]).argmax(axis=1)] == here,
        )
        step = max(1, AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), step):
            some = a[at : at + step]
            p, q = np.repeat(some, len(b)), np.tile(b, len(some))
            for agree in checks:
                keep = agree(p, q)
                p, q = p[keep], q[keep]
            up = cid[q] > cid[p]
            p, q = np.where(up, p, q), np.where(up, q, p)
            out.append(np.stack([cid[p], cid[q], root[p], root[q]], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({n: found[:, i] for i, n in enumerate(("u", "v", "ru", "rv"))})

    # adaptive coalescing sees bytes and not comparisons, so the number of tasks follows the work
    work = main.agg(F.sum(F.col("few") * F.col("all") + GROUP_COST * blocks * chunks)).first()[0] or 0
    unit = ("key", "block", "chunk")
    return left.unionByName(right).repartition(max(1, math.ceil(work / TASK_WORK)), *unit).groupBy(*unit).applyInArrow(run, PAIRS).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id, and root, which only rows of one
    component share; it is null where there are no words."""
    session(docs.sparkSession)
    least = percent / 100 - SLACK
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    signed = cut(annotate(given, ["text"], _signed, SIGNED, drop=["text"]))
    # the bands of a class are the same in all its rows
    grouped = signed.where("n_shingles > 0").groupBy("cls", "bands").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    # buckets of at least two classes
    spread = classes.select("cid", "copies", F.explode("bands").alias("key"))
    keys = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = cut(spread.join(keys, "key"))
    sets = cut(_sets(docs, text, cut(classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "cls", "rep", "bands"))))
    roots = None
    for step in range(ROUNDS + 2):
        if roots is None:
            open_ = members.withColumn("root", F.col("cid"))
        else:
            rooted = members.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
            open_ = cut(_apart(rooted))
            if open_.isEmpty():
                break
        pairs = _in_blocks(open_, sets, percent) if step > ROUNDS else _with_heads(open_, sets, least, step)
        links = cut(_verified(pairs, sets, percent))
        if roots is not None and links.isEmpty():
            continue
        joined = components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        if roots is None:
            roots = cut(joined.select(F.col("node").alias("cid"), "root"))
        else:  # what was a root before may have one now
            moved = joined.select(F.col("node").alias("root"), F.col("root").alias("now"))
            fresh = joined.join(roots.select(F.col("cid").alias("node")), "node", "left_anti").select(F.col("node").alias("cid"), "root")
            roots = cut(roots.join(moved, "root", "left").select("cid", F.coalesce("now", "root").alias("root")).unionByName(fresh))
    named = classes.select("cid", "cls", "least").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = cut(named.join(low, "root").select("cls", "component_id", "root"))
    forget(members, sets)
    out = signed.select("doc_id", "text_hash", "n_shingles", "cls").join(by_class, "cls", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component, and every row without words. Components may share an id, or have none: it is
    the root that tells them apart. Of rows of one id and text, the one stays whose other columns come first as JSON."""
    found = near_duplicates(docs, percent).where("n_shingles > 0 and doc_id <=> component_id")
    one = found.groupBy(F.col("root").alias("__root")).agg(F.min("component_id").alias("__id"), F.min("text_hash").alias("__hash"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = docs.where(worded).withColumn("__text", F.xxhash64("text"))
    joined = hashed.join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    turn = Window.partitionBy("__root").orderBy(F.to_json(F.struct(*others)) if others else F.lit(1))
    kept = joined.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").select(*docs.columns)
    return kept.unionByName(docs.where(~worded))
