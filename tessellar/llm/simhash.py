"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into d + r blocks: two fingerprints that differ
in at most d bits agree in r blocks at least, so they share the key of some
choice of r blocks.  Distinct fingerprints meet in the buckets of those keys
and are compared bit by bit.  A bucket sends out a spanning forest of its links
only, so the number of edges follows the number of fingerprints, not of pairs;
components of the edges are the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, forest, runs, split_hot, whole_groups, with_fields

#: Fingerprints of a bucket that one task compares with each other at once.
MOST = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit is 1 where it is set in over half the XXH64 (seed 42) of the shingles."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8")
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_ += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", words: int = 4) -> DataFrame:
    """docs with fp, the fingerprint as a signed long; null or empty text: 0.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text of fewer
    words than a shingle is one shingle.
    """

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for t in tables:
            fp = np.fromiter((fingerprint(x, words) for x in t.column("text").to_pylist()), np.uint64, t.num_rows)
            yield pa.table({"fp": pa.array(fp.view(np.int64))})

    return with_fields(docs, fn, {"text": text}, [("fp", T.LongType())])


def block_masks(count: int, most_bits: int) -> list[int]:
    """A mask for each choice of r of d + r blocks; r such that the key's bits
    number the fingerprints: unrelated ones then seldom share a key, however
    many there are."""
    for r in range(1, 7):
        blocks = most_bits + r
        if 64 * r // blocks >= math.log2(max(count, 2)) + 2:
            break
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, r)]


def _links(most_bits: int):
    """Spanning forests of the links within the buckets of a sorted partition."""

    def edges(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most_bits
        return a[near], b[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["mask", "key", "part_i", "part_j"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            at = runs(t, ["mask", "key", "part_i", "part_j"])
            begin = np.repeat(at[:-1], np.diff(at))
            size = np.repeat(np.diff(at), np.diff(at))
            place = np.arange(len(fp)) - begin
            got_a, got_b = [], []
            # small buckets together, by distance within the sorted rows; large ones row by row
            small = size <= 64
            for lag in range(1, int(size[small].max(initial=1))):
                a = np.flatnonzero(small & (place + lag < size))
                x, y = edges(fp, a, a + lag)
                got_a.append(x)
                got_b.append(y)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 64:
                    ga, gb = [], []
                    for i in range(lo, hi - 1):
                        near = np.flatnonzero(np.bitwise_count(fp[i + 1 : hi] ^ fp[i]) <= most_bits)
                        ga.append(np.full(len(near), i - lo))
                        gb.append(near + i + 1 - lo)
                    ga, gb = np.concatenate(ga), np.concatenate(gb)
                    keep = forest(hi - lo, ga, gb)
                    got_a.append(ga[keep] + lo)
                    got_b.append(gb[keep] + lo)
            if got_a:
                a, b = np.concatenate(got_a), np.concatenate(got_b)
                keep = forest(len(fp), a, b)
                s = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s[a[keep]]), pa.array(s[b[keep]])], names=["a", "b"])

    return run


def clusters(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, most_bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each row: the smallest doc_id among the
    rows whose fingerprints chain to this row's by links of at most most_bits.

    Rows with equal fingerprints (all texts without words, too) are one node
    each.  Repeated rows give repeated rows; a null doc_id takes part in links
    but is no component_id (a component of null ids only has a null one).
    Other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = cut(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), words=words).select("doc_id", "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    masks = block_masks(nodes.count(), most_bits)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"))
    dealt = split_hot(keyed, ["mask", "key"], F.col("fp"), MOST).select("mask", "key", "part_i", "part_j", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(n, "mask", "key", "part_i", "part_j").sortWithinPartitions("mask", "key", "part_i", "part_j", "fp")
    found = components(met.mapInArrow(_links(most_bits), "a long, b long").distinct())
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, most_bits: int = 4) -> DataFrame:
    """The rows of docs of which no other is a near-duplicate with a smaller
    doc_id; of repeated rows with one doc_id, one stays.  Rows with null ids stay."""
    found = clusters(docs, doc_id=doc_id, text=text, words=words, most_bits=most_bits)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.filter(F.col(f"`{doc_id}`").isNotNull()).join(kept, doc_id, "left_semi").dropDuplicates([doc_id])
    return named.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))
