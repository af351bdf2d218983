from fractions import Fraction

from pyspark.sql import functions as F

from tessellar.operators import intervals, timegrid
from tessellar.streaming import idempotent_sink


def merged(spark, rows, **k):
    df = spark.createDataFrame(rows, "k int, label string, s long, e long")
    return sorted(tuple(r) for r in intervals.merge_runs(df, ["k"], "label", "s", "e", **k).select("label", "s", "e", "n_merged").collect())


def test_interleaved_labels_split_runs(spark):
    rows = [(1, "a", 0, 10), (1, "b", 5, 6), (1, "a", 8, 12)]
    assert merged(spark, rows) == [("a", 0, 10, 1), ("a", 8, 12, 1), ("b", 5, 6, 1)]
    df = spark.createDataFrame(rows, "k int, label string, s long, e long")
    assert [(r.s, r.e, r.n_merged) for r in intervals.merge(df, ["k"], "s", "e").collect()] == [(0, 12, 3)]


def test_touching_and_nested_intervals_merge_and_order_is_irrelevant(spark):
    rows = [(1, "a", -5, 0), (1, "a", 2, 20), (1, "a", 3, 4), (1, "a", 22, 30), (1, "a", 33, 40)]
    want = [("a", -5, 30, 4), ("a", 33, 40, 1)]
    assert merged(spark, rows, gap=2) == want == merged(spark, rows[::-1], gap=2)
    assert merged(spark, [], gap=2) == []


def test_rounding_is_exact(spark):
    cases = [(n, d) for n in (-7, -5, -3, -2, -1, 0, 1, 2, 3, 5, 7, 2**62 + 1) for d in (1, 2, 4, 2_000_000_000)]
    for d in {d for _, d in cases}:
        df = spark.createDataFrame([(n,) for n, x in cases if x == d], "n long")
        for r in df.select("n", timegrid.round_half_even(F.col("n"), d).alias("q")).collect():
            assert r.q == round(Fraction(r.n, d))


def test_nearest_frame_ties_and_misses(spark):
    t = spark.createDataFrame([(1, 0, 100), (1, 1, 200), (1, 2, 900)], "r int, k long, target_ns long")
    f = spark.createDataFrame([(1, 7, 90, True), (1, 8, 110, True), (1, 9, 205, False)], "r int, frame_id long, frame_ns long, ok boolean")
    got = {x.k: (x.frame_id, x.status) for x in timegrid.nearest(t, f, ["r"], 20, "ok").collect()}
    assert got == {0: (7, "SELECTED"), 1: (9, "DECODE_FAILED"), 2: (None, "NO_FRAME")}


def test_sink_ignores_replays_and_refuses_conflicts(spark, tmp_path):
    sink = idempotent_sink(str(tmp_path / "t"), "id")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "id int, v string")
    sink(a, 0)
    sink(a, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    try:
        sink(spark.createDataFrame([(1, "z")], "id int, v string"), 2)
        raise AssertionError("a conflict went unnoticed")
    except ValueError:
        pass
