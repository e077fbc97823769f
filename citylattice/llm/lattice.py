"""Language-model scores from a subword lattice (Kudo, 2018: unigram language model over all segmentations).

The pieces and their scores come from an existing vocabulary file. The scores of such a file are ranks; weights fall with
the rank (Zipf). ``ROUNDS`` rounds of expectation and maximisation over the training words move the weights towards the
corpus, with the file's weights as a prior of ``PRIOR`` pieces: every segmentation of a word counts by its probability.
A word, with the sign that begins words, has the sum of the probabilities of all its segmentations, by the forward
recursion in log space over bytes; single bytes are pieces too, so that every word has one. Each training word is one
more edge of its lattice, from its first byte to its last: of N training tokens of V kinds, whole words have the share
N / (N + V) by their counts and the pieces the rest (Witten and Bell). A text's probability is the product over its
words and one end.

Beside it stands the add-one word model. Both need corpus counts for every word of every text. Texts are read once, in
blocks of about ``BLOCK`` bytes: a block lists its distinct words with training counts, and its documents as numbers of
these words. Words are counted over all blocks, each distinct word's lattice is run once, and every block gets back the
counts and probabilities of its own words only. The answers for the ``COMMON`` most spread words, short ones, a fixed size,
go to every executor; others are joined. No vocabulary is sent to all tasks, and no task holds more than a block.

Null texts are empty: one token, the end. A null id is in training. Without training texts the base is 0 for all and the
weights are those of the file. Repeated rows count as often as they occur and get a row each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import session
from citylattice.session import cut

BLOCK = 8 << 20
#: Words whose answers go to every executor, and their length at most.
COMMON, COMMON_BYTES = 4096, 64
ROUNDS, PRIOR, SHIFT = 1, 20_000.0, 10.0
#: Words of one lattice batch, in bytes.
LATTICE = 1 << 18
U64 = np.uint64


# --- blocks -----------------------------------------------------------------------------------------------------------

BLOCKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("train", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.ArrayType(T.IntegerType())), T.StructField("steps", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte strings data[start:end]."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1] - start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[at])])


def _packed(x: np.ndarray) -> bytes:
    """int32 values, their bytes grouped by significance, compressed."""
    raw = np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    n = int(np.frombuffer(x[:8], np.int64)[0])
    raw = np.frombuffer(pa.decompress(x[8:], decompressed_size=n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel() if n else np.zeros(0, np.int32)


class _Block:
    def __init__(self, number: int):
        self.number, self.bytes, self.parts = number, 0, []

    def add(self, ids, held, low, start, end, by_text, hashes):
        self.parts.append((ids, held, low, start, end, np.diff(by_text), hashes))
        self.bytes += len(low)

    def row(self) -> pa.RecordBatch:
        shift = np.concatenate([[0], np.cumsum([len(p[2]) for p in self.parts])])
        low = np.concatenate([p[2] for p in self.parts])
        start = np.concatenate([p[3] + s for p, s in zip(self.parts, shift)])
        end = np.concatenate([p[4] + s for p, s in zip(self.parts, shift)])
        tokens = np.concatenate([p[5] for p in self.parts])
        held = np.concatenate([p[1] for p in self.parts])
        _, first, number, counts = np.unique(np.concatenate([p[6] for p in self.parts]), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number, first = rank[number], first[order]
        doc = np.repeat(np.arange(len(tokens)), tokens)
        train = np.bincount(number[~held[doc]], minlength=len(first))
        pairs, times = np.unique(doc * np.int64(max(len(first), 1)) + number, return_counts=True)
        owner, word = pairs // max(len(first), 1), pairs % max(len(first), 1)
        kinds = np.bincount(owner, minlength=len(tokens))
        steps = word.copy()
        steps[1:] -= np.where(owner[1:] == owner[:-1], word[:-1], 0)
        ids = [i for p in self.parts for i in p[0]]
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        arrays = [pa.array([self.number], pa.int64()), one(_gather(low, start[first], end[first]), None), one(train, pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(tokens, pa.int32()), one(kinds, pa.int32()), pa.array([_packed(steps)], pa.binary()), pa.array([_packed(times)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=BLOCKED.names)


def _blocks(batches):
    task, made, block = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        ids, held = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offs in K.slices(batch.column(2)):
            block = block or _Block((task << 32) + made)
            low = K.LOWER[data]
            start, end, by_text = K.words(low, offs, K.SPACED)
            block.add(ids[lo:hi], held[lo:hi], low, start, end, by_text, K.word_hashes(low, start, end))
            if block.bytes >= BLOCK:
                yield block.row()
                block, made = None, made + 1
    if block:
        yield block.row()


# --- the lattice ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def read_pieces(path: str) -> tuple[tuple[bytes, ...], tuple[float, ...]]:
    """Pieces of a vocabulary file as bytes, and weights that fall with their rank; the last 256 are the bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights, n = [], [], model.get_piece_size()
    for i in range(n):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
            pieces.append(model.id_to_piece(i).encode())
            weights.append(1.0 / (SHIFT - model.get_score(i)))
    return tuple(pieces) + tuple(bytes([b]) for b in range(256)), tuple(weights) + (1.0 / (SHIFT + n),) * 256


SIGN = "▁".encode()


class Lattice:
    """Log probabilities of words under piece probabilities; the last entry of ``logp`` is the end of a text."""

    def __init__(self, pieces: tuple[bytes, ...], logp: np.ndarray):
        self.logp, self.n = logp, len(pieces)
        by_size: dict[int, list] = {}
        for i, p in enumerate(pieces[:-256]):
            by_size.setdefault(len(p), []).append(i)
        self.tables = []
        for size, own in sorted(by_size.items()):
            data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
            start = np.arange(len(own)) * size
            h = K.FIRST.spans(K.FIRST.prefix(data), start, start + size)
            order = np.argsort(h)
            screen = np.zeros(1 << 16, dtype=bool)
            screen[K.mix(h) >> U64(48)] = True
            self.tables.append((size, h[order], np.array(own)[order], screen))

    def edges(self, data: np.ndarray, word: np.ndarray, base: np.ndarray):
        """(start, end, piece) of all pieces in the words, by distance of the end from the word's start, then by word.
        ``word`` is each byte's word, ``base`` each word's first byte."""
        prefix, n = K.FIRST.prefix(data), len(data)
        starts, ends, found = [np.arange(n)], [np.arange(1, n + 1)], [self.n - 256 + data.astype(np.int64)]
        for size, keys, own, screen in self.tables:
            if n < size:
                break
            at = np.arange(n - size + 1)
            at = at[word[at] == word[at + size - 1]]
            h = K.FIRST.spans(prefix, at, at + size)
            near = screen[K.mix(h) >> U64(48)]
            at, h = at[near], h[near]
            where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[where] == h
            starts.append(at[same])
            ends.append(at[same] + size)
            found.append(own[where[same]])
        start, end, piece = map(np.concatenate, (starts, ends, found))
        far = end - base[word[start]]
        order = np.argsort(far * (n + 1) + end)
        return start[order], end[order], piece[order], far[order]

    def forward(self, data, word, base, edges) -> np.ndarray:
        """alpha at each byte position of its word, before the byte; the last position of a word is at index n + word."""
        start, end, piece, far = edges
        n, last = len(data), np.append(base[1:], len(data))
        slot = np.where(end == last[word[start]], n + word[start], end)
        alpha = np.full(n + len(base), -np.inf)
        alpha[base] = 0.0
        cuts = np.searchsorted(far, np.arange(1, far[-1] + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                to = slot[lo:hi]
                heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                alpha[to[heads]] = np.logaddexp.reduceat(alpha[start[lo:hi]] + self.logp[piece[lo:hi]], heads)
        return alpha

    def expected(self, data, word, base, edges, alpha, times) -> np.ndarray:
        """Expected uses of each piece, by the backward recursion."""
        start, end, piece, _ = edges
        n, last = len(data), np.append(base[1:], len(data))
        slot = np.where(end == last[word[start]], n + word[start], end)
        beta = np.full(n + len(base), -np.inf)
        beta[n:] = 0.0
        near = start - base[word[start]]
        order = np.argsort(start - near * (n + 1))
        s, t, p, d = start[order], slot[order], piece[order], -near[order]
        cuts = np.searchsorted(d, np.arange(d[0], 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                heads = np.flatnonzero(np.concatenate([[True], s[lo + 1 : hi] != s[lo : hi - 1]]))
                beta[s[lo:hi][heads]] = np.logaddexp.reduceat(beta[t[lo:hi]] + self.logp[p[lo:hi]], heads)
        share = np.exp(alpha[start] + self.logp[piece] + beta[slot] - alpha[n + word[start]]) * times[word[start]]
        return np.bincount(piece, weights=share, minlength=self.n)

    def batches(self, words: pa.Array):
        """Parts of a binary column as (first, end, bytes with the sign, word of each byte, first byte of each)."""
        for lo, hi, data, offs in K.slices(words, LATTICE):
            k = len(SIGN)
            base = offs[:-1] + k * np.arange(hi - lo)
            whole = np.empty(len(data) + k * (hi - lo), np.uint8)
            mine = np.ones(len(whole), dtype=bool)
            for j in range(k):
                whole[base + j] = SIGN[j]
                mine[base + j] = False
            whole[mine] = data
            yield lo, hi, whole, np.repeat(np.arange(hi - lo), np.diff(offs) + k), base

    def score(self, words: pa.Array) -> np.ndarray:
        """Natural log of each word's probability."""
        out = np.zeros(len(words))
        for lo, hi, data, word, base in self.batches(words):
            out[lo:hi] = self.forward(data, word, base, self.edges(data, word, base))[len(data) :]
        return out


def _normal(weights: np.ndarray) -> np.ndarray:
    return np.log(weights) - math.log(math.fsum(weights))


def _trained(pieces, weights: np.ndarray, counts: DataFrame, n_train: int) -> np.ndarray:
    """Log probabilities after ``ROUNDS`` rounds. What comes to the driver is one number for each piece."""
    prior = np.exp(_normal(np.append(weights, weights.max())))
    logp = np.log(prior)
    for _ in range(ROUNDS if n_train else 0):
        lattice = Lattice(pieces, logp)

        def expect(batches, lattice=lattice):
            total = np.zeros(lattice.n)
            for batch in batches:
                times = batch.column(1).to_numpy().astype(float)
                for lo, hi, data, word, base in lattice.batches(batch.column(0)):
                    edges = lattice.edges(data, word, base)
                    total += lattice.expected(data, word, base, edges, lattice.forward(data, word, base, edges), times[lo:hi])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "uses"])

        sums = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(len(pieces) + 1)
        uses[sums["piece"].to_numpy()] = sums["uses"].to_numpy()
        uses[-1] = n_train
        logp = _normal(uses + PRIOR * prior)
    return logp


# --- the operator -----------------------------------------------------------------------------------------------------

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", held=None) -> DataFrame:
    """One row for each document: its scores under both models, learnt from documents where ``held`` is false."""
    session(docs.sparkSession)
    held = F.coalesce(held if held is not None else F.lit(False), F.lit(False))
    given = docs.select(F.col(doc_id).cast("long").alias("id"), held.alias("held"), F.col(text).alias("text"))
    blocks = cut(given.mapInArrow(_blocks, BLOCKED))
    n_train = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    listed = blocks.select(F.explode(F.arrays_zip("words", "train")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.train").alias("c"))
    counts = cut(listed.groupBy("word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("homes")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = n + n_train, v + (n_train > 0)
    pieces, weights = read_pieces(vocabulary)
    lattice = Lattice(pieces, _trained(pieces, np.array(weights), counts, n_train))

    def run(batches):
        for batch in batches:
            pieced = lattice.score(batch.column(0)) + math.log(max(v, 1) / max(n + v, 1))
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column(1).to_numpy() / max(n + v, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.logaddexp(pieced, whole) / math.log(10))], names=["word", "c", "p"])

    # words of most blocks would be hot keys; COMMON of them at most, of COMMON_BYTES at most, go to every executor instead
    spread = counts.where((F.col("homes") > 1) & (F.octet_length("word") <= COMMON_BYTES)).orderBy(F.desc("homes"), "word").limit(COMMON)
    answered = "word binary, c long, p double"
    common = cut(spread.select("word", "c").mapInArrow(run, answered))
    others = counts.join(F.broadcast(common.select("word")), "word", "left_anti").select("word", "c").mapInArrow(run, answered)
    wanted = blocks.select(F.col("block").alias("home"), F.posexplode("words").alias("i", "word"))
    here = wanted.join(F.broadcast(common), "word")
    there = wanted.join(F.broadcast(common.select("word")), "word", "left_anti").join(others, "word")
    answers = here.unionByName(there).select("home", "i", "c", "p")
    end = math.log10((n_train + v * math.exp(lattice.logp[-1])) / (n + v)) if v else float(lattice.logp[-1] / math.log(10))
    return answers.groupBy("home").cogroup(blocks.drop("words", "train").groupBy("block")).applyInArrow(_finish(n, v, n_train, end), SCORED)


def _finish(n: int, v: int, n_train: int, end: float):
    def run(answers: pa.Table, blocks: pa.Table) -> pa.Table:
        at = answers.column("i").to_numpy()
        c, p = np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at], p[at] = answers.column("c").to_numpy(), answers.column("p").to_numpy()
        parts = []
        for b in range(blocks.num_rows):
            row = {k: blocks.column(k)[b] for k in ("ids", "held", "tokens", "kinds", "steps", "counts")}
            ids, held = row["ids"].values, row["held"].values
            tokens, kinds = row["tokens"].values.to_numpy(), row["kinds"].values.to_numpy()
            steps, times = _unpacked(row["steps"].as_py()).astype(np.int64), _unpacked(row["counts"].as_py())
            offs = np.concatenate([[0], np.cumsum(kinds)])
            owner = np.repeat(np.arange(len(kinds)), kinds)
            word = np.cumsum(steps)
            word -= np.repeat(np.where(kinds > 0, (word - steps)[np.minimum(offs[:-1], max(len(word) - 1, 0))], 0) if len(word) else np.zeros(len(kinds), np.int64), kinds)
            base = np.log10(c + 1.0) - math.log10(n + v + 1)
            total = lambda x: np.bincount(owner, weights=x, minlength=len(kinds))
            known = total(times * (c[word] > 0)).astype(np.int64) + (n_train > 0)
            parts.append(pa.table({"doc_id": ids, "held_out": held, "n_tokens": pa.array(tokens + 1, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(kinds), n), pa.int64()), "base_score": total(times * base[word]) + math.log10(n_train + 1) - math.log10(n + v + 1), "score": total(times * p[word]) + end}))
        return pa.concat_tables(parts)

    return run


def default_vocabulary() -> str:
    """Place of the piece vocabulary; ``score`` takes any other."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return score(docs, vocabulary or default_vocabulary(), held=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
