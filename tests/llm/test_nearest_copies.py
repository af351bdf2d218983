"""Neighbours among many equal vectors."""

import numpy as np

from tessellar.llm import hnsw


def test_copies_beyond_the_beam_go_by_their_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[rng.permutation(3000)[:2000]] = x[0]
    ids = rng.permutation(3000)
    ids[1] = ids[0]  # one id twice
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, *range(2, 3000, 60)]
    queries = spark.createDataFrame([rows[i] for i in asked], "vec_id long, embedding array<double>")
    hits = n = 0
    got = hnsw.nearest(table, queries, k=20, shard_rows=3000).toPandas()
    for i in asked:
        near = got[got.query_id == ids[i]].sort_values("rank").vec_id.tolist()
        s = np.round(x @ x[i], 9)
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        if (x[i] == x[0]).all():
            assert near == want
        hits += len(set(near) & set(want))
        n += len(set(want))
    assert hits / n >= 0.98
