"""Near-duplicate embeddings by E8 lattice hashing.

Each table projects a unit vector to eight dimensions by a random Gaussian
matrix, scales and shifts it, and decodes it to the nearest point of the E8
lattice: its home cell.  A vector also probes the neighbouring cells whose
points come next.  Two vectors meet where one is at home and the other at home
or probing; cosines of meeting vectors are computed in double precision.  A
pair that meets in several cells counts in one of them only, which both sides
can tell, so links are counted and linked up inside the cells and no list of
pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import components, cut, forest, runs, split_hot, whole_groups

#: Neighbouring cells that a vector probes in each table.
PROBES = 8
#: Share of the pairs just at the threshold that all tables together may miss,
#: and the most tables that are spent on it.
MISS, MOST_TABLES = 0.01, 24
#: Vectors of a cell that one task compares with each other at once.
MOST = 2048
#: Chance partners of a vector in its home cell, at which the scale is set.
CHANCE = 64
SEED = 20240229


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i in range(8) for j in range(i + 1, 8) for s in (1, -1) for t in (1, -1)]
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array([*whole, *half], float)


ROOTS = _roots()


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest points whose whole coordinates have an even sum."""
    r = np.rint(y)
    off = y - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8 and D8 shifted by a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def scale_for(count: int) -> float:
    """Such that a random vector meets about CHANCE others of `count` at home:
    two points of a Gaussian of deviation s share a unit cell with a chance of
    (4 pi s^2) ^ -4.  Cells grow no fuller as the table grows."""
    return max(0.3, (max(count, 1) / CHANCE) ** 0.125 / math.sqrt(4 * math.pi))


@lru_cache(maxsize=8)
def _planes(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim, 8)), rng.random(8) * 2


def cells(x: np.ndarray, table: int, scale: float, probes: int) -> np.ndarray:
    """(rows, 1 + probes) longs: the home cell, then the neighbours by nearness."""
    planes, shift = _planes(x.shape[1], table)
    y = (x @ planes) * scale + shift
    home = e8(y)
    away = (ROOTS**2).sum(axis=1) - 2 * (y - home) @ ROOTS.T
    near = np.argpartition(away, probes - 1, axis=1)[:, :probes] if probes else np.empty((len(x), 0), np.int64)
    points = np.concatenate([home[:, None], home[:, None] + ROOTS[near]], axis=1)
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    h = np.full(twice.shape[:2], 0x9E3779B97F4A7C15 + table, np.uint64)
    for k in range(8):
        h = (h ^ twice[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def plan(count: int, dim: int, least: float, probes: int) -> tuple[float, int]:
    """Scale and number of tables.  A trial on random pairs of cosine `least`
    says how many of them one table finds; the scale shrinks (fuller cells)
    where more than MOST_TABLES would be needed to miss no more than MISS."""
    rng = np.random.default_rng(SEED)
    x, z = rng.standard_normal((2, 2000, dim))
    x = _unit(x)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = _unit(least * x + math.sqrt(max(0.0, 1 - least * least)) * _unit(z)) if dim > 1 else x
    scale = scale_for(count)
    while True:
        a, b = cells(x, 0, scale, probes), cells(y, 0, scale, probes)
        hit = min(0.999, float(((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).mean()))
        tables = math.ceil(math.log(MISS) / math.log(1 - hit)) if hit > 0.01 else MOST_TABLES + 1
        if tables <= MOST_TABLES:
            return scale, max(2, tables)
        scale *= 0.95


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _vectors(blobs: pa.Array, wide: bool) -> np.ndarray:
    kind = np.float64 if wide else np.float32
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


def packed(embeddings: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, bool]:
    """vec_id (long), v (binary of the components, null if it takes no part), dim."""
    ship(embeddings.sparkSession)
    wide = not isinstance(embeddings.schema[vector].dataType.elementType, T.FloatType)
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for x in b.column(1):
                v = None if not x.is_valid else x.values.cast(pa.float64() if wide else pa.float32())
                ok = v is not None and len(v) and not v.null_count
                v = v.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                ok = ok and bool(np.isfinite(v).all() and v.any())
                out.append((v + kind(0)).tobytes() if ok else None)
                dims.append(len(v) if ok else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])

    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("x"))
    return rows.mapInArrow(run, "vec_id long, v binary, dim int"), wide


def near_duplicates(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    n_links counts the other rows found with a cosine of `least` or more;
    component_id is the smallest vec_id that links lead to; kept says that it
    is the row's own.  Equal vectors are one node of the search and link with
    each other.  A vector that is null, empty, zero or holds null or non-finite
    components, or has no vec_id, links with nothing and is its own component;
    vectors of different lengths don't link; rows that share a vec_id share a
    component.  Other columns are not read.  An empty table gives none.
    """
    spark = embeddings.sparkSession
    made, wide = packed(embeddings, vec_id, vector)
    rows = cut(made)
    part = rows.filter("v is not null and vec_id is not null")
    classes = cut(part.groupBy("v", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*"), F.max("dim")).first()
    scale, planned = plan(size[0], size[1] or 1, least, probes)
    tables = tables or planned

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                some = b.take(pa.array(at))
                x = _unit(_vectors(some.column(0), wide))
                for t in range(tables):
                    c = cells(x, t, scale, probes)
                    for k in range(c.shape[1]):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(c[:, k]), pa.array(np.full(n, k == 0)), some.column(1), some.column(2), some.column(3), some.column(0)], names=["t", "cell", "home", "dim", "node", "copies", "v"])

    met = classes.select("v", "dim", "node", "copies").mapInArrow(hashed, "t int, cell long, home boolean, dim int, node long, copies long, v binary")
    key = ["t", "cell", "dim"]
    dealt = split_hot(met, key, F.col("node"), MOST)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [*key, "part_i", "part_j"]
    sorted_ = dealt.repartition(n_parts, *parts).sortWithinPartitions(*parts)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, parts):
            at = runs(t, parts)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                g = t.slice(lo, hi - lo)
                i, j = g.column("part_i")[0].as_py(), g.column("part_j")[0].as_py()
                home, chunk = g.column("home").to_numpy(), g.column("chunk").to_numpy()
                h = np.flatnonzero(home)
                if not len(h):
                    continue
                x = _unit(_vectors(g.column("v").combine_chunks(), wide))
                pairs_a, pairs_b = [], []
                for begin in range(0, len(h), 512):
                    hs = h[begin : begin + 512]
                    a, b = np.nonzero(x[hs] @ x.T >= least - 1e-12)
                    a = hs[a]
                    ok = (a != b) & (~home[b] | (a < b))
                    if i != j:  # rows of one chunk meet in that chunk's own bucket
                        ok &= chunk[a] != chunk[b]
                    pairs_a.append(a[ok])
                    pairs_b.append(b[ok])
                a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
                if not len(a):
                    continue
                exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)])
                a, b = a[exact >= least], b[exact >= least]
                own = _owned(x, a, b, g.column("t")[0].as_py(), g.column("cell")[0].as_py(), scale, tables, probes)
                keep = forest(hi - lo, a, b)
                node, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
                links = np.zeros(hi - lo, np.int64)
                np.add.at(links, a[own], copies[b[own]])
                np.add.at(links, b[own], copies[a[own]])
                who = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[who], node[a[keep]]])), pa.array(np.concatenate([np.full(len(who), -1), node[b[keep]]])), pa.array(np.concatenate([links[who], np.zeros(len(keep), np.int64)])), pa.array(np.concatenate([np.zeros(len(who), bool), np.ones(len(keep), bool)]))],
                    names=["a", "b", "links", "edge"],
                )

    found = cut(sorted_.mapInArrow(link, "a long, b long, links long, edge boolean").groupBy("a", "b", "edge").agg(F.sum("links").alias("links")))
    counted = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("far"))
    rooted = components(found.filter("edge and a <> b").select("a", "b"))
    known = classes.join(counted, "node", "left").join(rooted, "node", "left")
    known = known.select("v", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = part.join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _owned(x: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, cell: int, scale: float, tables: int, probes: int) -> np.ndarray:
    """Whether this cell is the first, by table and number, in which each pair meets."""
    own = np.ones(len(a), bool)
    if not len(a):
        return own
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    pa_, pb = place[: len(a)], place[len(a) :]
    for t in range(table + 1):
        if not own.any():
            break
        c = cells(x[used], t, scale, probes)
        for k in range(0, len(a), 65536):
            s = slice(k, k + 65536)
            ca, cb = c[pa_[s]], c[pb[s]]
            a_in_b, b_in_a = (cb == ca[:, :1]).any(axis=1), (ca == cb[:, :1]).any(axis=1)
            if t < table:
                own[s] &= ~(a_in_b | b_in_a)
            else:
                big = np.iinfo(np.int64).max
                own[s] &= np.minimum(np.where(a_in_b, ca[:, 0], big), np.where(b_in_a, cb[:, 0], big)) == cell
    return own
