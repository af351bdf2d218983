"""The reference operators as queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket
from ..operators import graphs, intervals, metrics, retrieval, sequences, timegrid, windows
from ..sources import frames, table
from . import evaluation, fusion, quality, review, service, streams  # noqa: F401  (registers its queries)
from .registry import ORACLE_SQL, QUERIES, S, query  # noqa: F401

FLAGSHIP = "a1_gap_merge"
GAP = 600 * S

FRAMES = "f AS (SELECT event_id, CAST(user_id % 6 + 1 AS INTEGER) AS camera, user_id AS recording, event_type AS label, value, epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(round(value * 1e9) AS BIGINT) AS end_ns FROM events)"


def _islands_sql(source: str, keys: str, gap: int) -> str:
    part = f"PARTITION BY {keys} ORDER BY start_ns, end_ns"
    return f"""(SELECT *, sum(opens) OVER ({part} ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start_ns > max(end_ns) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} OR row_number() OVER ({part}) = 1 THEN 1 ELSE 0 END AS opens FROM {source}))"""


@query(f"WITH {FRAMES}, i AS {_islands_sql('f', 'recording', GAP)} SELECT recording, CAST(island AS BIGINT) AS island, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_merged FROM i GROUP BY recording, island")
def a1_gap_merge(spark, d):
    return intervals.merge(frames(spark, d), ["recording"], "start_ns", "end_ns", GAP)


@query(f"WITH {FRAMES}, i AS {_islands_sql('f', 'camera, label', GAP)} SELECT camera, label, CAST(island AS BIGINT) AS island, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_merged FROM i GROUP BY camera, label, island")
def i1_label_components(spark, d):
    return intervals.merge(frames(spark, d), ["camera", "label"], "start_ns", "end_ns", GAP)


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum(new) OVER (PARTITION BY camera ORDER BY start_ns, end_ns, label, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY camera ORDER BY start_ns, end_ns, label, event_id) = label THEN 0 ELSE 1 END AS new FROM f)),
i AS {_islands_sql('r', 'camera, run', GAP)} SELECT camera, CAST(run AS BIGINT) AS run, label, CAST(island AS BIGINT) AS island, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_merged FROM i GROUP BY camera, run, label, island""")
def a3_candidate_reduction(spark, d):
    return intervals.merge_runs(frames(spark, d), ["camera"], "label", "start_ns", "end_ns", GAP, ["event_id"])


@query(f"WITH {FRAMES}, i AS {_islands_sql('f', 'camera', 0)}, m AS (SELECT camera, island, max(end_ns) - min(start_ns) AS len FROM i GROUP BY camera, island) SELECT camera, CAST(sum(len) AS BIGINT) AS covered, count(*) AS pieces FROM m GROUP BY camera")
def a4_union_length(spark, d):
    return intervals.union_length(frames(spark, d), ["camera"], "start_ns", "end_ns")


@query(f"""WITH {FRAMES}, i AS {_islands_sql('f', 'camera', 0)}, m AS (SELECT camera, island, min(start_ns) AS s, max(end_ns) AS e FROM i GROUP BY camera, island)
SELECT CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS both_ns, count(*) AS pieces FROM m a JOIN m b ON a.camera = 1 AND b.camera = 2 AND a.s < b.e AND b.s < a.e""")
def a5_intersection_length(spark, d):
    m = intervals.merge(frames(spark, d).filter("camera in (1, 2)"), ["camera"], "start_ns", "end_ns")
    a = m.filter("camera = 1").select(F.lit(0).alias("k"), F.col("start_ns").alias("a_start"), F.col("end_ns").alias("a_end"))
    b = m.filter("camera = 2").select(F.lit(0).alias("k"), F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    hit = intervals.overlap_join(a, b, ["k"], 600 * S)
    return hit.agg(F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("both_ns"), F.count("*").alias("pieces"))


@query(f"""WITH {FRAMES}, i AS {_islands_sql('f', 'camera', 0)}, m AS (SELECT camera, min(start_ns) AS s, max(end_ns) AS e FROM i GROUP BY camera, island), g AS (SELECT camera, lead(s) OVER (PARTITION BY camera ORDER BY s) - e AS gap FROM m)
SELECT camera, count(*) AS n_gaps, max(gap) AS longest, quantile_disc(gap, 0.5) AS p50, quantile_disc(gap, 0.95) AS p95 FROM g WHERE gap IS NOT NULL GROUP BY camera""")
def a6_gap_summary(spark, d):
    m = intervals.merge(frames(spark, d), ["camera"], "start_ns", "end_ns")
    g = m.select("camera", (F.lead("start_ns").over(Window.partitionBy("camera").orderBy("start_ns")) - F.col("end_ns")).alias("gap")).dropna()
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by gap)").cast("long")
    return g.groupBy("camera").agg(F.count("*").alias("n_gaps"), F.max("gap").alias("longest"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


@query(f"WITH {FRAMES}, b AS (SELECT recording, min(start_ns) AS lo, max(start_ns) AS hi FROM f GROUP BY recording) SELECT event_id, greatest(start_ns - {30 * S}, lo) AS start_ns, least(end_ns + {30 * S}, hi) AS end_ns, start_ns - {30 * S} < lo OR end_ns + {30 * S} > hi AS truncated FROM f JOIN b USING (recording) WHERE greatest(start_ns - {30 * S}, lo) < least(end_ns + {30 * S}, hi)")
def p6_pad_clip(spark, d):
    f = frames(spark, d)
    b = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi"))
    return intervals.pad_clip(f.join(b, "recording"), "start_ns", "end_ns", 30 * S, F.col("lo"), F.col("hi")).select("event_id", "start_ns", "end_ns", "truncated")


@query(f"WITH {FRAMES} SELECT a.event_id AS a_id, b.event_id AS b_id, CAST(least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns) AS BIGINT) AS both_ns FROM f a JOIN f b ON a.label = b.label AND a.event_id < b.event_id AND a.start_ns < b.end_ns AND b.start_ns < a.end_ns")
def j6_interval_self_join(spark, d):
    f = frames(spark, d)
    a = f.select("label", F.col("event_id").alias("a_id"), F.col("start_ns").alias("a_start"), F.col("end_ns").alias("a_end"))
    b = f.select("label", F.col("event_id").alias("b_id"), F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    hit = intervals.overlap_join(a, b, ["label"], 600 * S).filter("a_id < b_id")
    return hit.select("a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("both_ns"))


@query(f"WITH {FRAMES} SELECT a.event_id AS a_id, b.event_id AS b_id, round((least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns)) / (greatest(a.end_ns, b.end_ns) - least(a.start_ns, b.start_ns)), 6) AS iou FROM f a JOIN f b ON a.recording = b.recording AND a.event_id < b.event_id AND a.start_ns < b.end_ns AND b.start_ns < a.end_ns")
def a30_interval_iou(spark, d):
    f = frames(spark, d)
    a = f.select("recording", F.col("event_id").alias("a_id"), F.col("start_ns").alias("a_start"), F.col("end_ns").alias("a_end"))
    b = f.select("recording", F.col("event_id").alias("b_id"), F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    hit = intervals.overlap_join(a, b, ["recording"], 600 * S).filter("a_id < b_id")
    return hit.select("a_id", "b_id", F.round(intervals.iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")), 6).alias("iou"))


_W1 = "SELECT camera, epoch, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(back AS INTEGER)) AS BIGINT) AS n_back, min(start_ns) AS first_ns, max(start_ns) AS last_ns FROM (SELECT *, CAST(sum(CAST(back AS INTEGER)) OVER (PARTITION BY camera ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (SELECT *, coalesce(start_ns <= lag(start_ns) OVER (PARTITION BY camera ORDER BY event_id), false) AS back FROM f)) GROUP BY camera, epoch"


@query(f"WITH {FRAMES} {_W1}")
def w2_clock_epochs(spark, d):
    e = sequences.clock_epochs(frames(spark, d), ["camera"], "event_id", "start_ns")
    return e.groupBy("camera", "epoch").agg(F.count("*").alias("n"), F.count_if("non_monotonic").alias("n_back"), F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns"))


@query(f"""WITH {FRAMES}, s AS (SELECT camera, lag(start_ns) OVER w AS from_ts, start_ns AS to_ts, start_ns - lag(start_ns) OVER w AS step FROM f WINDOW w AS (PARTITION BY camera ORDER BY start_ns)),
u AS (SELECT camera, quantile_disc(step, 0.5) AS usual, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY camera) SELECT camera, from_ts, to_ts, step, usual FROM s JOIN u USING (camera) WHERE n >= 2 AND step > greatest({60 * S}, usual * 3)""")
def w3_cadence_gaps(spark, d):
    return sequences.cadence_gaps(frames(spark, d), ["camera"], "start_ns", 60 * S, 3).select("camera", "from_ts", "to_ts", "step", "usual")


@query(f"WITH {FRAMES}, g AS (SELECT recording, event_id, event_id - lag(event_id) OVER (PARTITION BY recording ORDER BY event_id) AS step FROM f) SELECT recording, count(*) AS n_holes, CAST(sum(step - 1) AS BIGINT) AS missing FROM g WHERE step <> 1 GROUP BY recording")
def w4_sequence_gaps(spark, d):
    w = Window.partitionBy("recording").orderBy("event_id")
    g = frames(spark, d).select("recording", (F.col("event_id") - F.lag("event_id").over(w)).alias("step")).filter("step <> 1")
    return g.groupBy("recording").agg(F.count("*").alias("n_holes"), F.sum(F.col("step") - 1).alias("missing"))


@query(f"WITH {FRAMES} SELECT camera, (max(start_ns) - min(start_ns)) // (count(*) - 1) AS mean_step, (max(start_ns) - min(start_ns)) // (count(*) - 1) > {S} AS large FROM f GROUP BY camera HAVING count(*) > 1")
def w7_decode_interval(spark, d):
    g = frames(spark, d).groupBy("camera").agg(F.expr("(max(start_ns) - min(start_ns)) div (count(*) - 1)").alias("mean_step"), F.count("*").alias("n")).filter("n > 1")
    return g.select("camera", "mean_step", (F.col("mean_step") > S).alias("large"))


@query("""WITH h AS (SELECT event_type, list_sort(list(value)) AS v, quantile_disc(value, 0.95) AS p95_rank, round(quantile_cont(value, 0.95), 6) AS p95_linear FROM events GROUP BY event_type)
SELECT event_type, p95_rank, p95_linear, v[CAST(floor((len(v) - 1) * 95 / 100) AS INTEGER) + 1] AS p95_floor, v[least(len(v), CAST(floor(len(v) * 95 / 100) AS INTEGER) + 1)] AS p95_index FROM h""")
def a15_percentiles(spark, d):
    return sequences.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p95": 95}).withColumn("p95_linear", F.round("p95_linear", 6))


#: Grid step (over 3) and tolerance for recordings of 30 days.
STEP, TOLERANCE = 10_000 * S, 20_000 * S
_GRID = f"""b AS (SELECT recording, min(start_ns) AS lo, max(start_ns) + 1 AS hi FROM f GROUP BY recording), t AS (SELECT * FROM (SELECT recording, k, CAST(k * {STEP} AS BIGINT) // 3 + CASE WHEN 2 * ((k * {STEP}) % 3) > 3 THEN 1 ELSE 0 END AS target_ns, lo, hi FROM (SELECT recording, lo, hi, unnest(generate_series(CAST(lo * 3 // {STEP} - 1 AS BIGINT), CAST(hi * 3 // {STEP} + 1 AS BIGINT))) AS k FROM b)) WHERE target_ns >= lo AND target_ns < hi)"""


def _targets(f: DataFrame) -> DataFrame:
    spans = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), (F.max("start_ns") + 1).alias("hi"))
    n_parts = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows of many targets: dealt by number, which adaptive execution doesn't merge
    return timegrid.grid_targets(spans.repartition(n_parts, "recording"), ["recording"], "lo", "hi", STEP, 3)


@query(f"WITH {FRAMES}, {_GRID} SELECT recording, k, target_ns FROM t")
def grid_targets(spark, d):
    """Targets 10,000/3 s apart from the first to the last frame of every recording."""
    return _targets(frames(spark, d))


_NEAREST = f"""WITH {FRAMES}, {_GRID},
h AS (SELECT t.recording, k, target_ns, event_id, start_ns, label = 'error' AS bad, abs(start_ns - target_ns) AS delta, row_number() OVER (PARTITION BY t.recording, k ORDER BY label = 'error', abs(start_ns - target_ns), start_ns, event_id) AS n FROM t JOIN f ON t.recording = f.recording AND abs(start_ns - target_ns) <= {TOLERANCE}),
j AS (SELECT t.recording, t.k, t.target_ns, event_id AS frame_id, start_ns AS frame_ns, delta, CASE WHEN event_id IS NULL THEN 'NO_FRAME' WHEN bad THEN 'DECODE_FAILED' ELSE 'SELECTED' END AS status FROM t LEFT JOIN (SELECT * FROM h WHERE n = 1) h ON t.recording = h.recording AND t.k = h.k)
SELECT recording, k, target_ns, coalesce(frame_id, -1) AS frame_id, coalesce(frame_ns, -1) AS frame_ns, coalesce(delta, -1) AS delta, CASE WHEN status = 'SELECTED' AND row_number() OVER (PARTITION BY recording, status, frame_id ORDER BY delta, target_ns, k) > 1 THEN 'DEDUPLICATED_FRAME' ELSE status END AS status FROM j"""


@query(_NEAREST)
def j2_j3_nearest_frame(spark, d):
    """Each target of every recording with its nearest frame, each frame used once."""
    f = frames(spark, d)
    x = f.select("recording", F.col("event_id").alias("frame_id"), F.col("start_ns").alias("frame_ns"), (F.col("label") != "error").alias("usable"))
    found = timegrid.one_use(timegrid.nearest(_targets(f), x, ["recording"], TOLERANCE, "usable"), ["recording"])
    return found.fillna(-1, ["frame_id", "frame_ns", "delta"])


@query(f"WITH {FRAMES}, s AS (SELECT recording, event_id AS seg_id, start_ns AS a, coalesce(lead(start_ns) OVER (PARTITION BY recording ORDER BY start_ns), {2**62}) AS z FROM f WHERE label = 'signup') SELECT event_id, coalesce(seg_id, -1) AS seg_id FROM f LEFT JOIN s ON f.recording = s.recording AND start_ns >= a AND start_ns < z")
def j1_segment_lookup(spark, d):
    f = frames(spark, d)
    w = Window.partitionBy("recording").orderBy("start_ns")
    s = f.filter("label = 'signup'").select("recording", F.col("event_id").alias("seg_id"), F.col("start_ns").alias("seg_start"), F.coalesce(F.lead("start_ns").over(w), F.lit(2**62)).alias("seg_end"))
    return timegrid.segment_lookup(f.select("recording", "event_id", "start_ns"), s, ["recording"], "start_ns").select("event_id", "seg_id").fillna(-1)


@query(f"WITH {FRAMES} SELECT event_id, CAST(1000 + (CAST(start_ns AS HUGEINT) - 500) * 1001 // 1000 + CASE WHEN 2 * ((CAST(start_ns AS HUGEINT) - 500) * 1001 % 1000) > 1000 OR (2 * ((CAST(start_ns AS HUGEINT) - 500) * 1001 % 1000) = 1000 AND ((CAST(start_ns AS HUGEINT) - 500) * 1001 // 1000) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS aligned_ns FROM f")
def affine_time_map(spark, d):
    return frames(spark, d).select("event_id", timegrid.affine(F.col("start_ns"), 1001, 1000, 500, 1000).alias("aligned_ns"))


@query(f"""WITH {FRAMES}, s AS (SELECT camera, min((start_ns - {7200 * S}) // {3600 * S} + 1) AS a, max(start_ns // {3600 * S}) AS b, max(start_ns) + 1 AS stop FROM f GROUP BY camera), w AS (SELECT camera, stop, unnest(generate_series(a, b)) AS window_k FROM s),
c AS (SELECT camera, window_k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT camera, value, unnest([start_ns // {3600 * S} - 1, start_ns // {3600 * S}]) AS window_k FROM f) GROUP BY camera, window_k)
SELECT w.camera, w.window_k, coalesce(n, 0) AS n_rows, total, w.window_k * {3600 * S} AS window_start, least(w.window_k * {3600 * S} + {7200 * S}, stop) AS window_end FROM w LEFT JOIN c ON w.camera = c.camera AND w.window_k = c.window_k""")
def st2_sliding_windows(spark, d):
    return windows.sliding(frames(spark, d), ["camera"], "start_ns", 7200 * S, 3600 * S, [F.round(F.sum("value"), 4).alias("total")])


@query(f"WITH {FRAMES}, n AS (SELECT camera, start_ns // {1800 * S} AS bucket, event_id, abs(start_ns - (start_ns // {1800 * S} * {1800 * S} + {900 * S})) AS delta, start_ns FROM f) SELECT camera, bucket, event_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY camera, bucket ORDER BY delta, start_ns, event_id) AS r FROM n WHERE delta <= {600 * S}) WHERE r = 1")
def st7_bucket_best(spark, d):
    return windows.bucket_best(frames(spark, d), ["camera"], "start_ns", 1800 * S, 600 * S, "event_id")


@query(f"WITH {FRAMES} SELECT camera, start_ns // {3600 * S} AS segment, count(*) AS n, min(start_ns) AS first_ns, max(start_ns) + 1 AS end_ns FROM f GROUP BY ALL")
def st6_segment_sealing(spark, d):
    return frames(spark, d).groupBy("camera", bucket(F.col("start_ns"), 3600 * S).alias("segment")).agg(F.count("*").alias("n"), F.min("start_ns").alias("first_ns"), (F.max("start_ns") + 1).alias("end_ns"))


@query(f"WITH {FRAMES} SELECT camera, min(start_ns) AS start_ns, max(start_ns) + 1 AS end_ns, count(*) AS n FROM f GROUP BY camera")
def s8_stream_index(spark, d):
    return frames(spark, d).groupBy("camera").agg(F.min("start_ns").alias("start_ns"), (F.max("start_ns") + 1).alias("end_ns"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, cur.gapless FROM (SELECT *, max(turn) OVER p - min(turn) OVER p + 1 = count(*) OVER p AS gapless, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WINDOW p AS (PARTITION BY conv_id)) cur WHERE n = 1")
def w8_current_revision(spark, d):
    return sequences.current(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "gapless")


@query(f"WITH {FRAMES}, x AS (SELECT camera, sign(value - lag(value) OVER (PARTITION BY camera ORDER BY start_ns, event_id)) AS s, start_ns, event_id FROM f), y AS (SELECT camera, s, lag(s) OVER (PARTITION BY camera ORDER BY start_ns, event_id) AS p FROM x WHERE s <> 0) SELECT camera, CAST(coalesce(sum(CASE WHEN s <> p THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_reversals FROM y GROUP BY camera")
def x29_reversals(spark, d):
    return sequences.reversals(frames(spark, d), ["camera"], "start_ns", "value", "event_id")


@query(f"WITH {FRAMES}, c AS (SELECT camera, start_ns // {86400 * S} AS day, count(*) AS n FROM f GROUP BY ALL) SELECT camera, day, n, n - lag(n) OVER (PARTITION BY camera ORDER BY day) AS d_count, day - lag(day) OVER (PARTITION BY camera ORDER BY day) AS d_time FROM c QUALIFY d_time > 0")
def x28_rates(spark, d):
    c = frames(spark, d).groupBy("camera", bucket(F.col("start_ns"), 86400 * S).alias("day")).agg(F.count("*").alias("n"))
    return sequences.rates(c, ["camera"], "day", "n")


@query("WITH s AS (SELECT c_mktsegment AS name, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1), q AS (SELECT name, round(share, 9) AS share, floor(share * 97) AS base, round(share * 97 - floor(share * 97), 9) AS rest FROM s) SELECT name, share, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, name) <= 97 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM q")
def a36_largest_remainder(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).count()
    s = c.select("name", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))
    return sequences.largest_remainder(s, "share", 97, "name").select("name", F.round("share", 9).alias("share"), "seats")


@query("WITH p AS (SELECT event_type, 1 / (1 + exp(avg(value) / 50 - 4)) AS p FROM events GROUP BY event_type), r AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, event_type) + 1)) AS x FROM p) SELECT event_type, round(p, 9) AS p, round(max(x) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r")
def a33_holm(spark, d):
    p = table(spark, d, "events").groupBy("event_type").agg((1 / (1 + F.exp(F.avg("value") / 50 - 4))).alias("p"))
    return sequences.holm(p, "p", "event_type").select("event_type", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query("SELECT doc_id, lang FROM documents WHERE CAST('0x' || substr(sha256(concat_ws(chr(31), 'canary', source, CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.2")
def p10_hash_sampling(spark, d):
    return table(spark, d, "documents").filter(sequences.sampled([F.lit("canary"), F.col("source"), F.col("doc_id").cast("string")], 0.2)).select("doc_id", "lang")


@query("SELECT event_id, round(1 / (1 + exp(-(0.02 * value - 3))), 9) AS calibrated FROM events")
def p12_platt(spark, d):
    return table(spark, d, "events").select("event_id", F.round(sequences.sigmoid(0.02 * F.col("value") - 3), 9).alias("calibrated"))


@query("""WITH s AS (SELECT l.quality AS t, least(1.0, n_chars / 5000.0) AS p FROM documents d JOIN labels l USING (doc_id)), b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS p, avg(t) AS t, sum((p - t) * (p - t)) AS sq FROM s GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(p - t)) / sum(n), 6) AS ece FROM b""")
def a26_calibration(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    s = j.select(F.col("quality").alias("t"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))
    return metrics.calibration(s, "p", "t").select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query("""WITH j AS (SELECT lang, CAST(n_chars > 1500 AS INTEGER) AS p, quality AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t <> 1) AS fp, count(*) FILTER (p <> 1 AND t = 1) AS fn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def a23_precision_recall(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("p")).join(table(spark, d, "labels"), "doc_id")
    m = metrics.precision_recall(j, ["lang"], "p", "quality")
    return m.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH s AS (SELECT lang, n_chars // 500 AS bin, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents WHERE lang IN ('en', 'de') GROUP BY lang, n_chars // 500), b AS (SELECT bin, sum(CASE WHEN lang = 'en' THEN share ELSE 0 END) AS pa, sum(CASE WHEN lang = 'de' THEN share ELSE 0 END) AS pb FROM s GROUP BY bin) SELECT round(sum(abs(pa - pb)) / 2, 6) AS total_variation FROM b")
def a27_drift(spark, d):
    docs = table(spark, d, "documents").select("lang", F.floor(F.col("n_chars") / 500).alias("bin"))
    return metrics.histogram_drift(docs, "lang", "en", "de", "bin").select(F.round("total_variation", 6).alias("total_variation"))


@query("SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def a34_pareto(spark, d):
    return graphs.pareto(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice")


def _work(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    items = o.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_custkey").alias("lane"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("cost"))
    return items, items.select(F.col("id").alias("downstream"), F.floor(F.col("id") / 2).alias("upstream")).filter("upstream <> downstream")


_WORK = "w AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'PENDING' END AS state, o_custkey AS lane, o_orderpriority AS priority, o_totalprice AS cost FROM orders)"


@query(f"WITH {_WORK} SELECT id, lane FROM w WHERE state = 'PENDING' AND NOT EXISTS (SELECT 1 FROM w u WHERE u.id = w.id // 2 AND u.id <> w.id AND u.state <> 'SUCCEEDED')")
def j19_ready_work(spark, d):
    return graphs.ready(*_work(spark, d)).select("id", "lane")


@query(f"WITH {_WORK} SELECT priority, state, count(*) AS n, round(coalesce(sum(cost), 0), 2) AS cost, max(id) AS last_id FROM w GROUP BY priority, state")
def a19_state_summary(spark, d):
    return _work(spark, d)[0].groupBy("priority", "state").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"), F.max("id").alias("last_id"))


@query(f"WITH {_WORK} SELECT id, priority, cost FROM w WHERE state = 'PENDING' ORDER BY priority, cost DESC NULLS LAST, id LIMIT 50")
def t2_ready_queue(spark, d):
    return _work(spark, d)[0].filter("state = 'PENDING'").orderBy(F.asc("priority"), F.desc_nulls_last("cost"), "id").limit(50).select("id", "priority", "cost")


@query("SELECT o_orderkey, o_orderstatus, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.late, 0) AS late FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS late FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE o_totalprice > 1000")
def j11_j12_committed_runs(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("late"))
    o = table(spark, d, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").fillna(0, ["n_lines", "late"])


@query(f"WITH s AS (SELECT doc_id, source, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), ['the', 'and', 'der', 'ti'])) / 4.0 AS lexical FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 5000) SELECT doc_id, source, lexical FROM s WHERE lexical > 0 ORDER BY lexical DESC, doc_id LIMIT 50 OFFSET 10")
def r4_r5_structured_lexical(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en' and n_chars between 200 and 5000")
    ranked = retrieval.lexical(docs, "text", ["the", "and", "der", "ti"])
    return retrieval.page(ranked.select("doc_id", "source", "lexical"), [F.desc("lexical"), F.asc("doc_id")], 10, 50)


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c FROM embeddings, q WHERE label IN (1, 2, 3) AND vec_id <> 7) SELECT vec_id, round(c, 6) AS score FROM s WHERE c >= 0.05 ORDER BY c DESC, vec_id LIMIT 20")
def r6_vector_search(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 7").select(F.col("embedding").alias("e"))
    s = e.filter("label in (1, 2, 3) and vec_id <> 7").join(F.broadcast(q)).select("vec_id", retrieval.cosine(F.col("embedding"), F.col("e")).alias("c"))  # one query row
    return s.filter("c >= 0.05").orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("score"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a18_duplicate_reduce(spark, d):
    return table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' WHEN (d.n_chars > 1000) <> (l.quality = 1) THEN 'differs' ELSE 'ok' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def j9_reconcile(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"), "n_chars")
    b = table(spark, d, "labels").select(F.col("doc_id").alias("b"), "quality")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when((F.col("n_chars") > 1000) != (F.col("quality") == 1), "differs").otherwise("ok")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("doc_id"), state.alias("state"))


@query("WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') SELECT l_partkey, true AS new FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION SELECT l_partkey, false FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u1_u2_set_operations(spark, d):
    lines = table(spark, d, "lineitem")
    a = lines.filter("l_returnflag = 'R'").select("l_partkey").distinct()
    b = lines.filter("l_returnflag = 'A'").select("l_partkey").distinct()
    return a.join(b, "l_partkey", "left_anti").withColumn("new", F.lit(True)).unionByName(a.join(b, "l_partkey", "left_semi").withColumn("new", F.lit(False)))


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY value DESC, event_id) AS n FROM f), t AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS m FROM r WHERE n <= 30) SELECT event_id, camera, value FROM t WHERE m <= 100")
def t6_budgets(spark, d):
    own, all_ = Window.partitionBy("camera").orderBy(F.desc("value"), "event_id"), [F.desc("value"), F.asc("event_id")]
    kept = frames(spark, d).withColumn("n", F.row_number().over(own)).filter("n <= 30")
    return kept.orderBy(*all_).limit(100).select("event_id", "camera", "value")


@query(f"""WITH {FRAMES}, a AS (SELECT recording, event_id, start_ns, row_number() OVER (PARTITION BY recording ORDER BY start_ns, event_id) AS i FROM f), b AS (SELECT recording, min(start_ns) AS t0 FROM f GROUP BY recording)
SELECT camera, count(*) AS n, quantile_disc(step, 0.5) AS p50, quantile_disc(step, 0.95) AS p95, max(step) AS longest FROM (SELECT camera, start_ns - lag(start_ns) OVER (PARTITION BY camera ORDER BY start_ns, event_id) AS step FROM f) WHERE step IS NOT NULL GROUP BY camera""")
def a21_alignment_metrics(spark, d):
    w = Window.partitionBy("camera").orderBy("start_ns", "event_id")
    s = frames(spark, d).select("camera", (F.col("start_ns") - F.lag("start_ns").over(w)).alias("step")).dropna()
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by step)").cast("long")
    return s.groupBy("camera").agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("step").alias("longest"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def dimension_joins(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))
