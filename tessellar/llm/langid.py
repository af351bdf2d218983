"""Language identification by naive Bayes over hashed character n-grams.

A text is lower-cased; whatever isn't a letter becomes a space.  Its n-grams of
one to three characters hash into a fixed number of features.  Batches are
scored as a sparse matrix (each document's row lists its features) times the
dense matrix of log probabilities, in pieces of bounded size: long texts are
summed over pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_fields

#: Documents of each language that are learnt from, at most; hash bits; n-gram sizes.
SAMPLE, BITS, SIZES = 512, 16, (1, 2, 3)
#: Added to each feature's count.
SMOOTH = 0.1
#: Characters that are scored at once.
PIECE = 400_000
#: Parts of a language's rows that are looked through side by side for the sample.
PARTS = 64
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, their begins, features) of pieces of a batch: a sparse
    matrix by rows.  A document may go on in the next piece."""
    letters = _letters()
    sizes = max(SIZES)
    docs, parts, before, size = [], [], [], 0

    def piece():
        lens = np.array([len(p) for p in parts])
        c = np.concatenate(parts)
        c = np.where(letters[c], c, 32).astype(np.uint32)
        begins = np.cumsum(lens) - lens
        h = np.zeros(len(c), np.uint32)
        cols = []
        end = np.repeat(begins + lens, lens)
        at = np.arange(len(c))
        told = np.repeat(begins + np.array(before), lens)  # up to here the piece before has them
        blank = np.ones(len(c), bool)
        for n in range(1, sizes + 1):
            shifted = np.zeros_like(c)
            shifted[: len(c) - n + 1] = c[n - 1 :]
            h = (h ^ shifted) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            blank &= shifted == 32
            if n in SIZES:
                # an n-gram of spaces only says nothing, nor one across a document's end
                cols.append(np.where((at + n <= end) & (at + n > told) & ~blank, (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS), 1 << BITS))
        return np.array(docs), begins * len(cols), np.stack(cols, axis=1).ravel()

    for i, text in enumerate(texts):
        codes = _codes(text)
        for at in range(0, len(codes), PIECE):
            # pieces of a document overlap, so that no n-gram is lost between them
            part = codes[max(0, at - sizes + 1) : at + PIECE]
            docs.append(i)
            before.append(at - max(0, at - sizes + 1))
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield piece()
                docs, parts, before, size = [], [], [], 0
    if parts:
        yield piece()


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        p = counts + SMOOTH
        self.logs = np.vstack([np.log(p / p.sum(axis=0)), np.zeros(len(langs))]).astype(np.float32)
        self.prior = np.log(docs / docs.sum()) if len(langs) else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior probability; ties to the first by code point."""
        given = [x or "" for x in texts]
        some = np.array([any(map(str.isalpha, x)) for x in given], bool)
        if not len(self.langs):
            return [UNKNOWN] * len(given), np.zeros(len(given))
        total = np.tile(self.prior, (len(given), 1))
        for docs, begins, features in _features(given):
            np.add.at(total, docs, np.add.reduceat(self.logs[features], begins, axis=0))
        best = total.argmax(axis=1)
        gap = total - total[np.arange(len(given)), best][:, None]
        p = 1 / np.exp(np.maximum(gap, -700)).sum(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)], np.where(some, p, 0.0)


def fit(docs: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of at most SAMPLE documents of each language, those whose doc_id
    hashes lowest: the same at every run.  learn: which rows may be learnt from
    (all).  Rows without a language or doc_id are not.  Priors are even, up to
    the sample.  The model holds 2^BITS + 1 numbers for each language."""
    rows = docs if learn is None else docs.filter(learn)
    rows = rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang")).dropna()
    # lowest of parts of a language first, so that no task gets a frequent language's rows of all tasks
    rows = rows.withColumn("_h", F.xxhash64("_id")).withColumn("_part", F.pmod(F.hash("_id"), F.lit(PARTS)))
    for keys in (["_lang", "_part"], ["_lang"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "_id"))).filter(F.col("_n") <= SAMPLE).drop("_n")
    picked = rows.select("_id", "_lang").distinct()
    got = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang")).join(F.broadcast(picked), ["_id", "_lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for k in langs:
                held.setdefault(k, np.zeros((1 << BITS) + 1))
                n[k] = n.get(k, 0) + 1
            for which, begins, features in _features(texts):
                for d, lo, hi in zip(which, begins, [*begins[1:], len(features)], strict=True):
                    held[langs[d]] += np.bincount(features[lo:hi], minlength=(1 << BITS) + 1)
        for k, v in held.items():
            hit = np.flatnonzero(v[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(hit) + 1)), pa.array(np.append(hit, -1)), pa.array(np.append(v[hit], n[k]).astype(np.int64))], names=["lang", "feature", "n"])

    # languages x features sums at most
    sums = got.select("_lang", "_text").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    of, feature, number = np.array(sums.column("lang").to_pylist(), object), sums.column("feature").to_numpy(), sums.column("n").to_numpy()
    langs = sorted(set(of.tolist()))
    counts, docs_of = np.zeros((1 << BITS, len(langs))), np.ones(len(langs))
    for j, k in enumerate(langs):
        f, n = feature[of == k], number[of == k]
        counts[f[f >= 0], j] = n[f >= 0]
        docs_of[j] = max(1, n[f < 0].sum())
    return Model(langs, counts, docs_of)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability (0 to 1).

    Whole texts count.  A text that is null or has no letters gets "und" and 0,
    as does every text if nothing was learnt.  Repeated rows are predicted
    each; columns pass through, but those of the added names are replaced; an
    empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for t in tables:
            langs, score = held.value.predict(t.column("text").to_pylist())
            yield pa.table({"lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.clip(score, 0, 1))})

    return with_fields(docs, fn, {"text": text}, [("lang_pred", T.StringType()), ("score", T.DoubleType())])
