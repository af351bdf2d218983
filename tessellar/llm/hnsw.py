"""Approximate nearest neighbours by a small-world graph per shard.

Rows are dealt by hash into shards of a bounded size.  A shard is a
hierarchical navigable small-world graph: layers of ever fewer nodes, each
layer one flat array of neighbour numbers.  Vectors are inserted, and queries
searched, many at a time: every query of a batch walks its own beam, but each
step of all of them is one gather and one product.  Largest inner product
becomes nearest distance by one more coordinate, sqrt(M^2 - |x|^2), which is 0
for a query.  Equal vectors of a shard are one node, which stands for all their
rows.  Each query block visits every shard; the shards' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .lattice import _vectors, packed

SHARD_ROWS = 8192
#: Links of a node (twice as many in the lowest layer), beam widths.
LINKS, EF_BUILD, EF_SEARCH = 24, 96, 192
QUERY_BLOCK = 256
SEED = 77003


class Graph:
    """vectors: (n, d) float64.  layers[l]: (n, links) int32 neighbour numbers, -1 where none."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, batch: int = 128):
        n = len(vectors)
        norm2 = (vectors**2).sum(axis=1)
        top = norm2.max(initial=0)
        self.x = np.hstack([vectors, np.sqrt(np.maximum(top - norm2, 0))[:, None]]).astype(np.float32)
        self.links = links
        rng = np.random.default_rng(SEED)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(int), 8)
        level[0] = level.max(initial=0)
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = 0
        done = 1
        while done < n:
            # a batch no larger than what stands finds its neighbours there and within itself
            new = np.arange(done, min(n, done + min(batch, max(1, done // 2))))
            self._insert(new, level[new], ef)
            done = int(new[-1]) + 1

    def _insert(self, new: np.ndarray, level: np.ndarray, ef: int) -> None:
        x = self.x[new]
        at = np.full(len(new), self.entry, np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level >= k
            if not here.all():
                low = np.flatnonzero(~here)
                at[low] = self._greedy(x[low], at[low], k)
            if here.any():
                some = np.flatnonzero(here)
                ids, dist = self._beam(x[some], at[some][:, None], k, ef)
                at[some] = ids[:, 0]
                # those inserted with it, in the same layer
                mates = new[some]
                d = ((x[some][:, None] - x[some][None]) ** 2).sum(axis=2) if len(some) <= 64 else np.maximum((x[some] ** 2).sum(axis=1)[:, None] + (x[some] ** 2).sum(axis=1)[None] - 2 * x[some] @ x[some].T, 0)
                np.fill_diagonal(d, np.inf)
                d[np.triu_indices(len(some))] = np.inf  # each knows those before it
                ids = np.concatenate([ids, np.broadcast_to(mates.astype(np.int32), d.shape)], axis=1)
                dist = np.concatenate([dist, d], axis=1)
                ids = np.where(np.isinf(dist), -1, ids)
                chosen = self._diverse(ids, dist, self.links)
                self.layers[k][mates, : self.links] = chosen
                self._back(mates, chosen, k)

    def _diverse(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than
        to any chosen before; rows short of that are filled with the nearest left."""
        order = np.argsort(dist, axis=1, kind="stable")[:, : 3 * most]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        v = self.x[ids]
        sq = (v * v).sum(axis=2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        ok = ids >= 0
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            shadowed = (taken[:, :c] & (between[:, c, :c] < dist[:, c, None])).any(axis=1)
            taken[:, c] = ok[:, c] & ~shadowed & (taken[:, :c].sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(ok, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(ok, ids, -1), order, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _back(self, mates: np.ndarray, chosen: np.ndarray, k: int) -> None:
        """Links from the chosen back to the new; full rows are chosen anew."""
        layer = self.layers[k]
        a, b = np.repeat(mates, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0].astype(np.int32), b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, first, count = np.unique(b, return_index=True, return_counts=True)
        have = (layer[nodes] >= 0).sum(axis=1)
        room = layer.shape[1]
        place = np.arange(len(b)) - np.repeat(first, count) + np.repeat(have, count)
        fits = np.repeat(have + count <= room, count)
        layer[b[fits], place[fits]] = a[fits]
        full = np.flatnonzero(have + count > room)
        for at in range(0, len(full), 256):
            rows = full[at : at + 256]
            widest = int(count[rows].max())
            more = np.full((len(rows), widest), -1, np.int32)
            for i, r in enumerate(rows):
                more[i, : count[r]] = a[first[r] : first[r] + count[r]]
            ids = np.concatenate([layer[nodes[rows]], more], axis=1)
            dist = ((self.x[ids] - self.x[nodes[rows]][:, None]) ** 2).sum(axis=2)
            dist[ids < 0] = np.inf
            layer[nodes[rows]] = self._diverse(ids, dist, room)

    def _greedy(self, x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        best = ((self.x[at] - x) ** 2).sum(axis=1)
        live = np.arange(len(x))
        while len(live):
            ids = self.layers[k][at[live]]
            dist = ((self.x[ids] - x[live][:, None]) ** 2).sum(axis=2)
            dist[ids < 0] = np.inf
            j = dist.argmin(axis=1)
            d = dist[np.arange(len(live)), j]
            nearer = d < best[live]
            live = live[nearer]
            at[live] = ids[nearer, j[nearer]]
            best[live] = d[nearer]
        return at

    def _beam(self, x: np.ndarray, at: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest found from the entries at (rows, any), nearest first; -1 and inf where fewer."""
        n, layer = len(x), self.layers[k]
        seen = np.zeros((n, len(self.x)), bool)
        rows = np.arange(n)
        ids = np.full((n, ef), -1, np.int32)
        dist = np.full((n, ef), np.inf, np.float32)
        open_ = np.zeros((n, ef), bool)
        w = min(ef, at.shape[1])
        ids[:, :w] = at[:, :w]
        dist[:, :w] = ((self.x[at[:, :w]] - x[:, None]) ** 2).sum(axis=2)
        open_[:, :w] = True
        seen[rows[:, None], at[:, :w]] = True
        live = rows
        step = 4  # nodes of a beam that are opened at once
        while len(live):
            cost = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(cost, min(step, ef - 1), axis=1)[:, :step]
            good = np.isfinite(np.take_along_axis(cost, pick, 1))
            go = good.any(axis=1)
            live, pick, good = live[go], pick[go], good[go]
            if not len(live):
                break
            np.put_along_axis(closing := open_[live], pick, False, 1)
            open_[live] = closing
            from_ = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
            nb = np.where(from_[:, :, None] >= 0, layer[from_], -1).reshape(len(live), -1)
            nb = np.sort(nb, axis=1)
            fresh = nb >= 0
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            fresh &= ~seen[live[:, None], nb]
            r, c = np.nonzero(fresh)
            node = nb[r, c]
            seen[live[r], node] = True
            far = dist[live].max(axis=1)
            d_all = np.full(nb.shape, np.inf, np.float32)
            diff = self.x[node] - x[live[r]]
            d_all[r, c] = np.einsum("ij,ij->i", diff, diff)
            useful = d_all < far[:, None]
            widest = int(useful.sum(axis=1).max(initial=0))
            if not widest:
                continue
            keep = np.argpartition(d_all, min(widest, d_all.shape[1] - 1), axis=1)[:, :widest]
            more_d = np.take_along_axis(d_all, keep, 1)
            more_i = np.take_along_axis(nb, keep, 1)
            all_d = np.concatenate([dist[live], more_d], axis=1)
            all_i = np.concatenate([ids[live], more_i], axis=1)
            all_o = np.concatenate([open_[live], np.isfinite(more_d)], axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            open_[live] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of up to ef near vectors of each query, -1 where fewer."""
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        # the length of a query changes no order of inner products; unit length keeps distances in range
        q = (q / np.linalg.norm(q, axis=1, keepdims=True) * max(1e-30, float(np.abs(self.x).max()))).astype(np.float32)
        at = np.full(len(q), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            at = self._greedy(q, at, k)
        return self._beam(q, at[:, None], 0, min(ef, len(self.x)))[0]


class Rows:
    """A shard's rows: one graph node a distinct vector, and the ids of each in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows come in any order; graphs don't
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # -0.0 is 0.0
        _, first, node = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        node = rank[node.ravel()]
        self.x = x[np.sort(first)]
        self.ids = ids[np.argsort(node, kind="stable")]
        self.count = np.bincount(node)
        self.begin = np.cumsum(self.count) - self.count
        #: rows of one id, at most
        self.repeats = int(np.unique(ids, return_counts=True)[1].max())
        self.graph = Graph(self.x)

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of each query's k best rows but its own."""
        most = k + self.repeats  # so many rows hold k others
        found = self.graph.search(q, max(ef, most))
        score = np.einsum("qd,qkd->qk", q, self.x[found])
        size = np.where(found >= 0, np.minimum(self.count[found], most), 0)
        order = np.argsort(np.where(found >= 0, -score, np.inf), axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(size, order, 1), axis=1) < most
        last = np.take_along_axis(order, np.minimum(before.sum(axis=1), order.shape[1] - 1)[:, None], 1)
        # nodes after the last one needed come in only if as near
        enough = ~before[:, -1:]
        r, c = np.nonzero((size > 0) & (~enough | (score >= np.take_along_axis(score, last, 1))))
        n = size[r, c]
        at = np.repeat(self.begin[found[r, c]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, ids, s = np.repeat(r, n), self.ids[at], np.repeat(score[r, c], n)
        other = ids != q_ids[row]
        row, ids, s = row[other], ids[other], s[other]
        order = np.lexsort((ids, -s, row))
        row, ids, s = row[order], ids[order], s[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], ids[best], s[best]


def nearest(embeddings: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest found.

    Candidates are all rows of embeddings but those with the query's own
    vec_id; nearness is the inner product in double precision, largest first,
    ties to the smaller vec_id; all candidates if there are fewer than k.
    Vectors that are null, empty, zero or hold null or non-finite components,
    or have no vec_id, take no part, nor do those of another length than the
    query.  Repeated rows are candidates each.  Other columns are not read; no
    queries or no candidates give an empty table.
    """
    spark = embeddings.sparkSession
    made, wide = packed(embeddings, vec_id, vector)
    rows = cut(made.filter("v is not null and vec_id is not null"))
    asked, wide_q = packed(queries, vec_id, vector)
    asked = cut(asked.filter("v is not null and vec_id is not null"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries as blocks, one row each; a block goes to every shard."""
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                some = b.slice(at, QUERY_BLOCK)
                dims = some.column(2).to_numpy()
                for dim in np.unique(dims):
                    own = some.take(pa.array(np.flatnonzero(dims == dim)))
                    x = _vectors(own.column(1), wide_q).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([own.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dim", "ids", "v"])

    n_blocks = max(1, min(n_parts, math.ceil(asked.count() / QUERY_BLOCK)))
    blocks = asked.repartition(n_blocks, "vec_id").select("vec_id", "v", "dim").mapInArrow(bundle, "dim int, ids binary, v binary")
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "dim", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), "ids", "v")
    data = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("binary").alias("ids"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, held = None, [], [], None
        for b in batches:
            shard, dim, kind = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                if (shard[i], dim[i]) != key:
                    key, ids, vectors, held = (shard[i], dim[i]), [], [], None
                if kind[i] == 0:
                    ids.append(b.column(3)[i].as_py())
                    vectors.append(b.column(5)[i].as_py())
                    continue
                if not ids:
                    continue
                if held is None:
                    held = Rows(np.array(ids), np.frombuffer(b"".join(vectors), np.float64 if wide else np.float32).reshape(len(ids), -1).astype(np.float64))
                q_ids = np.frombuffer(b.column(4)[i].as_py(), np.int64)
                q = np.frombuffer(b.column(5)[i].as_py(), np.float64).reshape(len(q_ids), -1)
                r, near, score = held.nearest(q_ids, q, k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = data.unionByName(blocks).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "dim", "kind")
    got = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
