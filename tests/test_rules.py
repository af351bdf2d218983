"""Operators that SQL can't tell, against plain versions of themselves; sources and streams."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar import functions as fn
from tessellar.operators import association, evaluation, fusion, joins, quality, retrieval, review
from tessellar.sources import fixtures


def test_greedy_edges_are_the_sequential_choice(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 30), rng.randint(100, 130), rng.randint(1, 6) / 6) for g in "ab" for _ in range(250)]
    rows = list({(g, a, b): (g, a, b, s) for g, a, b, s in rows}.values())
    want, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, a) not in used and (g, b) not in used:
            used |= {(g, a), (g, b)}
            want.add((g, a, b))
    got = evaluation.greedy_edges(spark.createDataFrame(rows, "g string, a_id long, b_id long, iou double"), "g").collect()
    assert {(r.g, r.a_id, r.b_id) for r in got} == want and len(got) == len(want)
    assert evaluation.greedy_edges(spark.createDataFrame([], "g string, a_id long, b_id long, iou double"), "g").count() == 0


@pytest.mark.parametrize("abstain", [False, True])
def test_adjudication_is_the_sequential_choice(spark, abstain):
    rng = random.Random(7)
    rows = [(k, i, s, s + rng.randint(1, 40), rng.randint(0, 20) / 20, rng.random() < 0.9) for k in (1, 2) for i in range(60) for s in [rng.randint(0, 900)]]
    want = {}
    for k in (1, 2):
        final = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if not r[5]:
                want[k, r[1]] = "ABSTAINED"
                continue
            met = [f for f in final if f[2] < r[3] and r[2] < f[3]]
            if not met:
                final.append(r)
                want[k, r[1]] = "FINAL"
                continue
            best = max([r, *met], key=lambda x: (x[4], x[1]))
            close = any(abs(best[4] - x[4]) <= 0.1 for x in [r, *met] if x is not best)
            final = [f for f in final if f not in met]
            for x in [r, *met]:
                want[k, x[1]] = "FINAL" if x is best and not close and not abstain else "ABSTAINED"
            if not close and not abstain:
                final.append(best)
    df = spark.createDataFrame(rows, "k int, id long, start_ns long, end_ns long, confidence double, resolved boolean")
    assert {(r.k, r.id): r.verdict for r in fusion.adjudicate(df, "k", 0.1, abstain).collect()} == want


def test_tracks_close_and_batches_of_a_stream_are_steps(spark, tmp_path):
    steps = [[(1, 0, 1, "a", 0, 10), (1, 0, 2, "b", 0, 5)], [(1, 1, 3, "a", 12, 20), (1, 1, 4, "a", 500, 510)], [(1, 2, 5, "b", 6, 9), (1, 2, 6, "a", 511, 520)]]
    kind = "r int, step int, id long, label string, start_ns long, end_ns long"
    got = {r.track: (r.label, r.start_ns, r.end_ns, r.n, r.state) for r in fusion.tracks(spark.createDataFrame(sum(steps, []), kind), "r", 5).collect()}
    assert got == {0: ("b", 0, 5, 1, "CLOSED"), 1: ("a", 0, 20, 2, "CLOSED"), 2: ("a", 500, 520, 2, "UPDATED"), 3: ("b", 6, 9, 1, "OPEN")}
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = fusion.track_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "r", 5)

        def keep(batch, _, i=i):
            batch.withColumn("i", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))

        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.i):
        last[r.track] = (r.label, r.start_ns, r.end_ns, r.n, r.state)
    assert last == got


def test_clusters_and_leakage_groups(spark):
    rng = random.Random(5)
    edges = [(a, b) for a, b in combinations(range(60), 2) if rng.random() < 0.012] + [(k, k + 1) for k in range(100, 160)]
    nodes = [*range(60), *range(100, 161)]
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = association.components(spark.createDataFrame(edges, "a_id long, b_id long"), spark.createDataFrame([(n,) for n in nodes], "id long")).collect()
    assert {r.id: r.component for r in got} == root
    rows = [(1, "x", None), (2, "x", "p"), (3, "y", "p"), (4, None, None), (5, None, None)]
    got = association.shared_groups(spark.createDataFrame(rows, "id long, s string, t string"), "id", ["s", "t"]).collect()
    assert {r.id: r.component for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_bootstrap_covers_the_mean_and_is_the_same_again(spark):
    rng = random.Random(1)
    rows = [(i, sum(v), len(v)) for i in range(400) for v in [[rng.gauss(5 + rng.random(), 2) for _ in range(3)]]]
    df = spark.createDataFrame(rows, "k long, t double, n long")
    a, b = (evaluation.bootstrap(x, "t", "n", 300, 3).first() for x in (df, df.repartition(5)))
    assert abs(a["mean"] - b["mean"]) < 1e-9 and abs(a["lower"] - b["lower"]) < 1e-9
    _, low, high = evaluation.bootstrap_exact([t / n for _, t, n in rows], 300, 3)
    assert a["lower"] < a["mean"] < a["upper"] and abs(a["lower"] - low) < 0.05 and abs(a["upper"] - high) < 0.05


def test_rules_that_must_fail_do(spark):
    one = spark.range(1)
    bad = [
        one.select(quality.total_map(F.lit("odd"), {"a": "GOOD"})), one.select(quality.completion(F.lit("COMPLETE"), F.lit("COMPLETE"), F.lit(None).cast("string"))),
        one.select(fn.checked_long(F.lit("9223372036854775808").cast("decimal(38,0)"))), one.select(fn.recording_identity("n", F.lit("AB"))), one.select(fixtures.camera_of(F.lit("t/odd"), {"left": 1})),
        joins.exact_join(spark.createDataFrame([(1, 2), (1, 3)], "k int, a int"), spark.createDataFrame([(1, 4)], "k int, b int"), ["k"]),
        retrieval.build_index(spark.createDataFrame([("r", "d", "x")], "rev string, digest string, v string"), spark.createDataFrame([("e", "r", 1)], "ev string, rev string, seq long"), "ev", "rev", "seq", "digest"),
    ]
    for df in bad:
        with pytest.raises(Exception):
            df.collect()
    with pytest.raises(ValueError):
        retrieval.append(spark.createDataFrame([(1, "a")], "k int, d string"), spark.createDataFrame([(1, "b")], "k int, d string"), "k", "d")
    with pytest.raises(ValueError):
        fixtures.at_most(spark.range(5), 4)
    assert fixtures.at_most(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        review.split_interval(one, "id", "id", 5, 5)


def test_statuses_by_severity(spark):
    rows = [("a", s) for s in ("GOOD", "UNUSABLE", "UNKNOWN")] + [("b", "DEGRADED"), ("b", "GOOD")]
    got = {r.k: r.status for r in quality.worst(spark.createDataFrame(rows, "k string, s string"), ["k"], "s").collect()}
    assert got == {"a": "UNKNOWN", "b": "DEGRADED"}


def test_canonical_json_escapes_as_little_as_may_be(spark):
    texts = ["plain", 'q"\\/', "\x00\x1f\n\té😀", "", None]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "n long, t string, b boolean")
    kinds = {"b": T.BooleanType(), "n": T.LongType(), "t": T.StringType()}
    got = [r.j for r in df.select(fn.canonical_json(kinds, t=F.col("t"), n=F.col("n"), b=F.col("b")).alias("j")).collect()]
    assert got == [json.dumps({"b": True, "n": i, "t": t}, ensure_ascii=False, separators=(",", ":")) for i, t in enumerate(texts)]


def test_buckets_are_exact_at_nanoseconds(spark):
    hour = 3_600_000_000_000
    rows = [472222 * hour - 1, 472222 * hour, -1, 0, -hour, 2**62 + 1]
    got = [r.b for r in spark.createDataFrame([(r,) for r in rows], "n long").select(fn.bucket(F.col("n"), hour).alias("b")).collect()]
    assert got == [r // hour for r in rows]


def test_fixture_documents_and_their_problems(spark, tmp_path):
    good = {"recording_id": "r", "duration_ns": 100, "streams": [{"topic": "a/left", "codec": "h264", "width": 4, "height": 3, "fps": 10.0, "frames": [{"ordinal": 0, "ts_ns": 1}, {"ordinal": 1, "ts_ns": 50}]}]}
    odd = {**good, "recording_id": "s", "streams": [{**good["streams"][0], "frames": [{"ordinal": 0, "ts_ns": 9}, {"ordinal": 1, "ts_ns": 9}, {"ordinal": 1, "ts_ns": 100}]}]}
    (tmp_path / "f").mkdir()
    for k, doc in enumerate((good, odd)):
        (tmp_path / "f" / f"{k}.json").write_text(json.dumps(doc))
    f = fixtures.fixture_frames(spark, str(tmp_path / "f"))
    assert f.count() == 5 and [(r.recording_id, r.problems) for r in fixtures.source_problems(f, ["recording_id", "topic"]).collect()] == [("s", "NON_MONOTONIC,DUPLICATE_ORDINAL,OUT_OF_RANGE")]


def test_blobs_are_stored_once_by_content(spark, tmp_path):
    at = str(tmp_path / "blobs")
    a = spark.createDataFrame([(b"x",), (b"y",), (b"x",)], "body binary")
    assert fixtures.store(a, at).count() == 2 and fixtures.store(a, at).count() == 0
    assert fixtures.store(spark.createDataFrame([(b"z",)], "body binary"), at).count() == 1
    assert [r.intact for r in fixtures.verified(spark, at).collect()] == [True] * 3


def test_split_parts_cover_the_interval(spark):
    rng = random.Random(3)
    rows = [(i, s, s + rng.randint(1, 500)) for i in range(50) for s in [rng.randint(-100, 100)]]
    got = review.split_interval(spark.createDataFrame(rows, "i int, s long, e long"), "s", "e", 40, 7).collect()
    for i, s, e in rows:
        parts = sorted((r.part_start, r.part_end) for r in got if r.i == i)
        assert parts[0][0] == s and parts[-1][1] == e and all(z - a <= 40 for a, z in parts) and len(parts) == max(r.n_parts for r in got if r.i == i)
        assert all(b[0] == a[0] + 33 and b[0] == a[1] - 7 for a, b in zip(parts, parts[1:], strict=False))
