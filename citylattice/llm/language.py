"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

Texts become lower-cased runs of letters with one boundary sign between them; n-grams of one to three signs are counted
over the whole text, and the ``TOP`` most frequent, ties by code, form its profile. A language's profile is counted over
all its training texts, in parts that executors add up; only the ``TOP`` n-grams of each language reach the driver. The
prediction is the language with the least out-of-place distance, ties to the smaller name; the score is one minus that
distance over its maximum.

A text that is null or has no letter is ``und`` with score 0, as is every text when there is nothing to learn from.
Rows of null language teach nothing. Repeated rows count as often as they occur and get a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate, session

TOP, LONGEST = 300, 3
#: A count table of a training task is passed on when it has so many n-grams.
HELD = 200_000
#: Documents below this score are rejected by ``keep_known``: their n-grams hardly occur in any profile.
LEAST_SCORE = 0.02
_tables: list[np.ndarray] = []


def _signs() -> np.ndarray:
    """Lower-case code of each letter, 0 for everything else."""
    if not _tables:
        table = np.zeros(0x110000, dtype=np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _tables.append(table)
    return _tables[0]


def _code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and offsets of each text's."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    out = first.copy()
    two, three, four = (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), first >= 0xF0
    out[two] = (first[two] & 0x1F) << 6 | padded[at[two] + 1] & 0x3F
    out[three] = (first[three] & 0x0F) << 12 | (padded[at[three] + 1] & 0x3F) << 6 | padded[at[three] + 2] & 0x3F
    out[four] = (first[four] & 0x07) << 18 | (padded[at[four] + 1] & 0x3F) << 12 | (padded[at[four] + 2] & 0x3F) << 6 | padded[at[four] + 3] & 0x3F
    return np.minimum(out, 0x10FFFF), np.searchsorted(at, offs)


def grams_by_text(column: pa.Array):
    """(n-gram codes, counts) of each text; 21 bits a sign, 1 is the boundary."""
    for lo, hi, data, offs in K.slices(column):
        points, by_text = _code_points(data, offs)
        signs = _signs()[points]
        for i in range(hi - lo):
            s = signs[by_text[i] : by_text[i + 1]]
            letter = s > 0
            if not letter.any():
                yield np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # the first of several separators stays as the boundary
            s = np.where(letter, s, 1)[keep]
            s = np.concatenate([[1], s, [1]] if s[-1] != 1 else [[1], s])
            parts, codes = [s[s != 1]], s
            for n in range(2, LONGEST + 1):
                codes = codes[:-1] << 21 | s[n - 1 :]
                parts.append(codes)
            yield np.unique(np.concatenate(parts), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order of rank."""
    if len(codes) > 4 * TOP:  # only what can be among the first
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profiles by language. What comes to the driver is ``TOP`` n-grams for each language."""

    def count(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush():
            langs, codes, counts = [], [], []
            for name, (a, b) in held.items():
                c, inverse = np.unique(np.concatenate(a), return_inverse=True)
                langs += [name] * len(c)
                codes.append(c)
                counts.append(np.bincount(inverse, weights=np.concatenate(b)).astype(np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

        for batch in batches:
            names = batch.column(1).to_pylist()
            for name, (codes, counts) in zip(names, grams_by_text(batch.column(0))):
                a, b = held.setdefault(name, ([], []))
                a.append(codes)
                b.append(counts)
                size += len(codes)
                if size > 20 * HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    given = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    session(labelled.sparkSession)
    sums = given.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= TOP)
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _predictor(profiles: dict[str, np.ndarray]):
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(known) + 1, len(names)), -1, dtype=np.int64)  # the last row is for n-grams of no profile
    for j, k in enumerate(names):
        ranks[np.searchsorted(known, profiles[k]), j] = np.arange(len(profiles[k]))

    def compute(column):
        langs, scores = [], []
        for codes, counts in grams_by_text(column):
            if not len(codes) or not names:
                langs.append("und")
                scores.append(0.0)
                continue
            mine = profile(codes, counts)
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            at = np.where(known[at] == mine, at, len(known))
            there = ranks[at]
            away = np.where(there < 0, TOP, np.abs(there - np.arange(len(mine))[:, None])).sum(axis=0)
            best = int(away.argmin())
            langs.append(names[best])
            scores.append(1.0 - float(away[best]) / (TOP * len(mine)))
        return langs, scores

    return compute


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score."""
    return annotate(docs, [text], lambda: _predictor(profiles), FIELDS, drop=() if keep_text else [text])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score. A null id is not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, profiles, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts that have no letter and those whose n-grams hardly occur in any language."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    names = {f.name for f in FIELDS} & set(docs.columns)
    held = docs.withColumns({f"__{c}": F.col(c) for c in names})
    out = identify(held, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in docs.columns])
