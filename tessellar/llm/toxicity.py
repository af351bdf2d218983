"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts is kept as TF-IDF vectors over all of their
words; a term's idf is scaled by how much the word goes with the label (its
squared phi coefficient), so that words that tell come first and none is left
out.  An inverted index holds each term's postings by example, and for terms of
long postings the largest weight in each block of examples.  For a text, the
postings of rare terms are summed; these sums and the block maxima of the other
terms bound the cosines of each block, and blocks whose bound can't reach the k
nearest found are skipped.  Cosines of the nearest are then told in double
precision, so the k nearest are exact.  They vote, each with its cosine; a
logistic curve, fitted on a part of the sample that an index of the rest
scores, turns votes into probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import give_back, lean, with_fields

#: Labelled rows of each class that are learnt from, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1024, 2048
#: Neighbours; weight of the prior; part of the sample that calibrates (one in so many).
NEIGHBOURS, PRIOR_WEIGHT, PARTS = 16, 0.5, 4
#: Examples of a block of the index; examples from which a term has block maxima.
BLOCK, LONG = 64, 128
#: Share of its idf that a term keeps though it says nothing of the label.
FLOOR = 1e-4
#: Word shingles (their length, those kept of a text) and the share of them
#: from which texts of one label are copies.
SHINGLE, SKETCH, COPY = 3, 128, 0.8
#: Texts that are scored at once.
BATCH = 64
_WORD = re.compile(r"\w+")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def sketch(text: str | None) -> list[int]:
    """The smallest hashes of the shingles of a text's words, as signed longs."""
    from xxhash import xxh64_intdigest

    found = _WORD.findall((text or "").lower())
    ids = np.fromiter((xxh64_intdigest(w.encode("utf-8", "replace")) for w in found), np.uint64, len(found))
    width = max(1, min(SHINGLE, len(ids)))
    h = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))[:SKETCH].view(np.int64).tolist()


def copies(sketches: list[list[int]], labels: list[int]) -> list[list[int]]:
    """Groups of texts of one label that are, as wholes, copies or near copies
    of the group's first: words in order, by the share of common shingles."""
    groups: list[list[int]] = []
    heads: list[frozenset[int]] = []
    holders: dict[tuple[int, int], list[int]] = {}
    same: dict[tuple[int, frozenset[int]], int] = {}
    for i, s in enumerate(sketches):
        own = frozenset(x % (1 << 64) for x in s)
        g = same.get((labels[i], own))
        if g is None:
            shared = Counter(h for x in own for h in holders.get((labels[i], x), ()))
            for h, both in shared.most_common():
                if both < COPY * len(own):
                    break
                union = sorted(own | heads[h])[:SKETCH]
                if sum(x in own and x in heads[h] for x in union) >= COPY * len(union):
                    g = h
                    break
        if g is None:
            g = len(groups)
            groups.append([])
            heads.append(own)
            for x in own:
                holders.setdefault((labels[i], x), []).append(g)
        same.setdefault((labels[i], own), g)
        groups[g].append(i)
    return groups


class Sample:
    """Examples' words as numbers of one vocabulary, and how often each holds them."""

    def __init__(self, words: pa.ListArray, counts: pa.ListArray):
        held = words.flatten().dictionary_encode()
        self.terms = {w: i for i, w in enumerate(held.dictionary.to_pylist())}
        at = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        index, n = held.indices.to_numpy().astype(np.int32), counts.flatten().to_numpy().astype(np.float32)
        self.sets = [index[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
        self.counts = [n[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]

    @staticmethod
    def of(found: list[dict[str, int]]) -> Sample:
        return Sample(pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())))

    def some(self, which: list[int]) -> Sample:
        part = object.__new__(Sample)
        part.terms, part.sets, part.counts = self.terms, [self.sets[i] for i in which], [self.counts[i] for i in which]
        return part

    def words(self, i: int, names: list[str]) -> dict[str, int]:
        return {names[w]: int(n) for w, n in zip(self.sets[i], self.counts[i], strict=True)}


class Index:
    """Exact k nearest examples by TF-IDF cosine.

    groups: which examples are copies (each its own, if not told), whose words
    count once in a term's weight.
    """

    def __init__(self, sample: Sample, labels: list[int], ids: list[int] | None = None, groups: list[list[int]] | None = None, weights: tuple[float, float] = (1.0, 1.0), prior: float | None = None):
        sets, n = sample.sets, len(sample.sets)
        self.terms = sample.terms
        size = len(self.terms)
        groups = groups if groups is not None else [[i] for i in range(n)]
        df = np.zeros((2, size))
        for g in groups:
            df[int(labels[g[0]] > 0), np.unique(np.concatenate([sets[i] for i in g]))] += 1
        toxic, all_ = sum(labels[g[0]] > 0 for g in groups), len(groups)
        b, a = df
        c, e = toxic - a, all_ - toxic - b
        phi2 = (a * e - b * c) ** 2 / np.maximum(1, (a + b) * (c + e) * toxic * (all_ - toxic))
        self.idf = (np.log((1 + all_) / (1 + a + b)) + 1) * (FLOOR + phi2)
        vectors = [self._unit(s, x.astype(float)) for s, x in zip(sets, sample.counts, strict=True)]
        # examples with the same strongest term stand together, which keeps the bounds of blocks low
        order = sorted(range(n), key=lambda i: (int(sets[i][vectors[i].argmax()]) if len(sets[i]) else -1, i))
        self.labels = np.array([labels[i] > 0 for i in order], float)
        self.ids = np.array([ids[i] if ids and ids[i] is not None else -1 for i in order], np.int64)
        self.weights = np.where(self.labels > 0, weights[1], weights[0])
        self.prior = float(prior if prior is not None else self.labels.mean() if n else 0.0)
        self.curve = (1.0, 0.0)
        # examples' vectors one after another, then the same by term
        lens = np.array([len(sets[i]) for i in order], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lens)])
        self.of = np.concatenate([sets[i] for i in order]) if n else np.empty(0, np.int32)
        self.weight = np.concatenate([vectors[i] for i in order]) if n else np.empty(0)
        example = np.repeat(np.arange(n), lens)
        by_term = np.argsort(self.of, kind="stable")
        count = np.bincount(self.of, minlength=size)
        long = count >= LONG
        self.dense = np.full(size, -1, np.int64)  # a long term's row in the dense part
        self.dense[long] = np.arange(long.sum())
        self.blocks = max(1, -(-n // BLOCK))
        self.columns = np.zeros((int(long.sum()), self.blocks * BLOCK), np.float32)
        in_dense = long[self.of]
        self.columns[self.dense[self.of[in_dense]], example[in_dense]] = self.weight[in_dense]
        self.block_max = self.columns.reshape(len(self.columns), self.blocks, BLOCK).max(axis=2) if long.any() else np.zeros((0, self.blocks), np.float32)
        short = by_term[~long[self.of[by_term]]]
        self.posting, self.posted = example[short].astype(np.int32), self.weight[short].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.where(long, 0, count))])

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights (1 + ln tf) idf, of length 1."""
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.sqrt((v * v).sum()) if len(v) else v

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and weights of a text, of length 1, in the terms' order."""
        known = self.terms.get
        t = np.array([known(w, -1) for w in counts], np.int64)
        n = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(t)[int((t < 0).sum()) :]
        return t[order], self._unit(t[order], n[order])

    def nearest(self, given: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Examples and cosines above 0 of each vector's k nearest, nearest
        first, equally near ones in the examples' order."""
        n, wide = len(given), self.blocks * BLOCK
        q = np.zeros((n, len(self.columns)), np.float32)
        near = np.zeros((n, wide), np.float32)
        for i, (t, v) in enumerate(given):
            d = self.dense[t]
            q[i, d[d >= 0]] = v[d >= 0]
            t, v = t[d < 0], v[d < 0]
            size = self.starts[t + 1] - self.starts[t]
            at = np.repeat(self.starts[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            near[i] = np.bincount(self.posting[at], np.repeat(v, size) * self.posted[at], minlength=wide)
        bound = near.reshape(n, self.blocks, BLOCK).max(axis=2) + q @ self.block_max + np.float32(1e-5)
        least = np.full(n, -np.inf, np.float32)
        best = np.full((n, 0), 0, np.float32)
        scored = np.zeros((n, self.blocks), bool)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            go = np.flatnonzero(bound[:, b] > least)
            if not len(go):
                continue
            block = slice(b * BLOCK, (b + 1) * BLOCK)
            near[go, block] += q[go] @ self.columns[:, block]
            scored[go, b] = True
            new = np.full((n, BLOCK), -np.inf, np.float32)
            new[go] = near[go, block]
            best = np.concatenate([best, new], axis=1)
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
                least = best.min(axis=1) - np.float32(2e-5)
        out = []
        near[np.repeat(~scored, BLOCK, axis=1)] = -np.inf
        full = np.zeros(len(self.idf))
        for i, (t, v) in enumerate(given):
            some = np.flatnonzero((near[i] > 0) & (near[i] >= least[i]))
            some = some[some < len(self.labels)]
            full[t] = v
            size = self.begins[some + 1] - self.begins[some]
            if len(some):
                first = np.cumsum(size) - size
                at = np.repeat(self.begins[some] - first, size) + np.arange(size.sum())
                cosine = np.add.reduceat(self.weight[at] * full[self.of[at]], first)
            else:
                cosine = np.empty(0)
            full[t] = 0
            order = np.argsort(-cosine, kind="stable")[:k]
            out.append((some[order], cosine[order]))
        return out

    def evidence(self, found: Iterable[dict[str, int]]) -> list[tuple[float, list[int], list[float], list[int]]]:
        """Of each text the log odds of the votes, and the ids, cosines and labels of its neighbours."""
        out, found = [], iter(found)
        while some := [self.vector(c) for c in islice(found, BATCH)]:
            for i, s in self.nearest(some):
                vote, y = s * self.weights[i], self.labels[i]
                odds = np.log((vote @ y + PRIOR_WEIGHT * max(self.prior, 1e-6)) / (vote @ (1 - y) + PRIOR_WEIGHT * max(1 - self.prior, 1e-6)))
                out.append((float(odds), self.ids[i].tolist(), s.tolist(), y.astype(int).tolist()))
        return out

    def probability(self, odds: np.ndarray) -> np.ndarray:
        slope, base = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * odds + base, -500, 500))) if len(self.labels) else np.zeros(len(odds))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve of least log loss, by Newton steps;
    a weak pull towards (1, 0) keeps it finite where the classes don't overlap."""
    beta = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        pull = beta - [1.0, 0.0]
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.eye(2), a.T @ (w * (p - y)) + pull)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def learn_index(sample: Sample, labels: list[int], ids: list[int], sketches: list[list[int]], weights: tuple[float, float] = (1.0, 1.0), prior: float | None = None) -> Index:
    """An index whose curve is fitted on the examples of one part of the copy
    groups, by hash of the group's id, scored by an index of the others."""
    groups = copies(sketches, labels)
    held = [g for g in groups if zlib.crc32(str(ids[g[0]]).encode()) // 7 % PARTS == 0]
    rest = [g for g in groups if zlib.crc32(str(ids[g[0]]).encode()) // 7 % PARTS]
    curve = None
    if held and len({labels[g[0]] for g in held}) == 2 and len({labels[g[0]] for g in rest}) == 2:
        own = [i for g in rest for i in g]
        place = {i: k for k, i in enumerate(own)}
        share = prior if prior is not None else sum(labels) / len(labels)
        other = Index(sample.some(own), [labels[i] for i in own], [ids[i] for i in own], [[place[i] for i in g] for g in rest], weights, share)
        names = list(sample.terms)
        odds = np.array([e[0] for e in other.evidence(sample.words(g[0], names) for g in held)])
        y = np.array([labels[g[0]] for g in held], float)
        curve = logistic(odds, y, np.where(y > 0, weights[1], weights[0]))
        del other
    index = Index(sample, labels, ids, groups, weights, prior)
    index.curve = curve or index.curve
    return index


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """An index of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows, those
    whose doc_id hashes lowest: the same at every run.  learn: which rows of
    labels may be learnt from (all).  Rows without a doc_id or label, and
    labels without a document, are not learnt from; of several labels of a
    document the largest holds, of several texts the first by code point.  No
    labels at all give scores of 0.  Texts are turned into words and counts
    where they are; these come to the driver."""
    ship(docs.sparkSession)
    rows = labels if learn is None else labels.filter(learn)
    rows = rows.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y")).filter("_y in (0, 1)")
    picked = [rows.filter(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    some = F.broadcast(picked[0].unionByName(picked[1]))
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(some, "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [words(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array(map(sketch, texts), pa.list_(pa.int64()))], names=["id", "y", "words", "n", "sketch"])

    got = own.select(F.col("_id").cast("long").alias("_id"), "_y", "_text").mapInArrow(lean(count), "id long, y int, words array<string>, n array<int>, sketch array<long>").toArrow().sort_by("id")
    ids, y = got.column("id").to_pylist(), got.column("y").to_pylist()
    sample = Sample(*[got.column(c).combine_chunks() if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("words", "n")])
    # the sample's classes stand for as many rows as there are
    there = dict(rows.groupBy("_y").count().collect())
    held = Counter(y)
    share = [there.get(k, 0) / max(1, held[k]) for k in (0, 1)]
    mean = max(1e-9, sum(share[k] * held[k] for k in (0, 1)) / max(1, len(y)))
    prior = there.get(1, 0) / max(1, sum(there.values()))
    sketches = got.column("sketch").to_pylist()
    del got
    index = learn_index(sample, y, ids, sketches, (share[0] / mean, share[1] / mean), prior)
    del sample, sketches, ids, y
    give_back()  # else the driver keeps what the sample took
    return index


def score(docs: DataFrame, index: Index, *, text: str = "text", evidence: bool = False) -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic) and predicted (1 if
    score >= 0.5); with evidence, also neighbours, cosines and their_labels of
    the examples that voted, nearest first (ties in a fixed order).

    Whole texts count.  A null or empty text, and one without any word of the
    sample, gets the calibrated share of toxic texts.  Repeated rows are scored
    each; columns pass through, but those of the added names are replaced; an
    empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample's words

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        own = held.value
        for t in tables:
            found = own.evidence(words(x.as_py()) for x in t.column("text"))
            s = own.probability(np.array([f[0] for f in found], float))
            out = {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}
            if evidence:
                out |= {"neighbours": pa.array([f[1] for f in found], pa.list_(pa.int64())), "cosines": pa.array([f[2] for f in found], pa.list_(pa.float64())), "their_labels": pa.array([f[3] for f in found], pa.list_(pa.int32()))}
            yield pa.table(out)

    more = [("neighbours", T.ArrayType(T.LongType())), ("cosines", T.ArrayType(T.DoubleType())), ("their_labels", T.ArrayType(T.IntegerType()))] if evidence else []
    return with_fields(docs, fn, {"text": text}, [("score", T.DoubleType()), ("predicted", T.IntegerType()), *more])
