"""Quality assessment over the test tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import table
from .registry import SHOTS, S, query, shots

_STATUS = {"click": "GOOD", "view": "DEGRADED", "error": "UNUSABLE", "signup": "UNKNOWN", "purchase": "GOOD"}
_STATUS_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
_RANK = "CASE {} WHEN 'GOOD' THEN 0 WHEN 'DEGRADED' THEN 1 WHEN 'UNUSABLE' THEN 2 ELSE 3 END"
_NAME = "CASE {} WHEN 0 THEN 'GOOD' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'UNUSABLE' ELSE 'UNKNOWN' END"


def _observed(spark, d):
    return shots(spark, d).withColumn("status", quality.total_map(F.col("label"), _STATUS))


@query(f"WITH {SHOTS} SELECT event_id, {_STATUS_SQL} AS status FROM f")
def p3_camera_status(spark, d):
    return _observed(spark, d).select("event_id", "status")


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_size - 5 <= 0 THEN 'INVALID_RESOLUTION' END AS a, CASE WHEN p_retailprice - 905 <= 0 THEN 'INVALID_FPS' END AS b, CASE WHEN p_partkey % 7 = 0 THEN 'INVALID_DURATION' END AS c, CASE WHEN p_type <> 'ECONOMY' AND p_type <> 'SMALL' THEN 'UNSUPPORTED_CODEC' END AS e FROM part)
SELECT p_partkey, concat_ws(',', a, b, c, e) AS issues, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL AND e IS NULL THEN 'PASS' WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'DEGRADED' ELSE 'FAIL' END AS status FROM i""")
def p7_stream_checks(spark, d):
    codec = F.when(F.col("p_type") == "ECONOMY", "H264").when(F.col("p_type") == "SMALL", "av1").otherwise("raw")
    i = quality.stream_issues(F.col("p_size") - 5, F.col("p_size"), F.col("p_retailprice") - 905, F.col("p_partkey") % 7, codec)
    p = table(spark, d, "part").select("p_partkey", i.alias("i"))
    return p.select("p_partkey", F.array_join("i", ",").alias("issues"), quality.stream_status(F.col("i")).alias("status"))


@query("SELECT o_orderkey, CASE WHEN n_chars IS NULL THEN 'NOT_FOUND' WHEN n_chars = 0 THEN 'EMPTY' WHEN n_chars < 1024 THEN 'TOO_SMALL' ELSE 'PASS' END AS status FROM orders LEFT JOIN documents ON o_orderkey = doc_id")
def p8_container_checks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    j = table(spark, d, "orders").select("o_orderkey").join(docs, F.col("o_orderkey") == F.col("doc_id"), "left")
    return j.select("o_orderkey", quality.container_status(F.col("n_chars")).alias("status"))


def _reduced(where: str, gap: int, pad: int) -> str:
    w = "PARTITION BY recording ORDER BY start_ns, end_ns"
    return f"""WITH {SHOTS}, b AS (SELECT recording, min(start_ns) AS lo, max(end_ns) AS hi FROM f GROUP BY recording), s AS (SELECT * FROM f WHERE {where}),
i AS (SELECT *, sum(opens) OVER ({w} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_ns > max(end_ns) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} OR row_number() OVER ({w}) = 1 THEN 1 ELSE 0 END AS opens FROM s)),
g AS (SELECT recording, island, min(start_ns) AS a, max(end_ns) AS z, count(*) AS n_merged, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM i GROUP BY recording, island)
SELECT recording, CAST(island AS BIGINT) AS island, greatest(a - {pad}, lo) AS start_ns, least(z + {pad}, hi) AS end_ns, n_merged, cameras FROM g JOIN b USING (recording)"""


def _reduce(f, where: str, gap: int, pad: int):
    b = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi"))
    out = quality.reduce_intervals(f.filter(where).join(b, "recording"), ["recording"], "start_ns", "end_ns", "camera", gap, pad, F.col("lo"), F.col("hi"))
    return out.select("recording", "island", "start_ns", "end_ns", "n_merged", F.array_join("sources", ",").alias("cameras"))


@query(_reduced("label = 'error'", 600 * S, S // 2))
def a1_suspicion_reduction(spark, d):
    """Suspicious intervals merged across cameras, padded by half a second, clipped to the recording."""
    return _reduce(shots(spark, d), "label = 'error'", 600 * S, S // 2)


@query(_reduced("label IN ('view', 'error')", 0, 2 * S))
def a2_dense_units(spark, d):
    """Units of dense assessment: degraded and unusable intervals that touch, with context."""
    return _reduce(shots(spark, d), "label in ('view', 'error')", 0, 2 * S)


_COARSE = f"o AS (SELECT *, {_STATUS_SQL} AS status FROM f WHERE value > 60 AND label <> 'signup'), m AS (SELECT recording, camera, max({_RANK.format('status')}) AS r FROM o GROUP BY recording, camera), q AS (SELECT * FROM (SELECT DISTINCT recording FROM f), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS camera)), c AS (SELECT q.recording, q.camera, CASE WHEN r IS NULL THEN 'UNKNOWN' ELSE {_NAME.format('r')} END AS status FROM q LEFT JOIN m ON q.recording = m.recording AND q.camera = m.camera)"


def _coarse(spark, d, missing: str = "UNKNOWN"):
    o = _observed(spark, d)
    w = quality.worst(o.filter("value > 60 and label <> 'signup'"), ["recording", "camera"], "status")
    every = o.select("recording").distinct()
    return quality.six_slots(every.join(w, "recording", "left"), ["recording"], "status", missing)


@query(f"WITH {SHOTS}, o AS (SELECT *, {_STATUS_SQL} AS status FROM f), m AS (SELECT recording, camera, max({_RANK.format('status')}) AS r FROM o WHERE value > 100 GROUP BY recording, camera) SELECT recording, camera, {_NAME.format('r')} AS status FROM m")
def a9_worst_status(spark, d):
    return quality.worst(_observed(spark, d).filter("value > 100"), ["recording", "camera"], "status")


@query(f"WITH {SHOTS}, {_COARSE} SELECT recording, CASE WHEN bool_or(status = 'UNKNOWN') THEN 'INCOMPLETE' WHEN bool_or(status IN ('DEGRADED', 'UNUSABLE')) THEN 'REQUIRES_DENSE' ELSE 'COMPLETE' END AS coarse_status FROM c GROUP BY recording")
def a8_coarse_status(spark, d):
    return quality.coarse_status(_coarse(spark, d), ["recording"], "status")


_QUALITY = {"GOOD": 1.0, "DEGRADED": 0.6, "UNUSABLE": 0.1, "UNKNOWN": 0.0, "INCOMPLETE": 0.0}


@query(f"""WITH {SHOTS}, {_COARSE}, e AS (SELECT recording, camera, CASE WHEN max(value) > 200 THEN 'DEGRADED' ELSE 'GOOD' END AS status FROM f WHERE recording % 2 = 0 AND label = 'purchase' GROUP BY recording, camera),
r AS (SELECT c.recording, coalesce(e.status, CASE WHEN c.status = 'UNKNOWN' AND c.recording % 3 = 0 THEN 'INCOMPLETE' ELSE c.status END) AS status FROM c LEFT JOIN e ON c.recording = e.recording AND c.camera = e.camera),
g AS (SELECT recording, count(*) FILTER (status IN ('GOOD', 'DEGRADED')) AS usable, count(*) FILTER (status = 'INCOMPLETE') AS n_open, round(avg(CASE status WHEN 'GOOD' THEN 1.0 WHEN 'DEGRADED' THEN 0.6 WHEN 'UNUSABLE' THEN 0.1 ELSE 0.0 END), 4) AS overall_quality FROM r GROUP BY recording)
SELECT recording, CASE WHEN n_open > 0 THEN 'INCOMPLETE' WHEN usable = 6 THEN 'USABLE' WHEN usable >= 4 THEN 'DEGRADED' ELSE 'UNUSABLE' END AS overall_status, usable, overall_quality FROM g""")
def a7_recording_quality(spark, d):
    c = _coarse(spark, d)
    c = c.withColumn("status", F.when((F.col("status") == "UNKNOWN") & (F.col("recording") % 3 == 0), "INCOMPLETE").otherwise(F.col("status")))
    e = shots(spark, d).filter("recording % 2 = 0 and label = 'purchase'").groupBy("recording", "camera").agg(F.when(F.max("value") > 200, "DEGRADED").otherwise("GOOD").alias("status"))
    return quality.recording_status(c, e, ["recording"], 4, _QUALITY)


@query(f"""WITH {SHOTS}, {_COARSE}, k AS (SELECT recording, CASE WHEN bool_or(status = 'UNKNOWN') THEN 'INCOMPLETE' WHEN bool_or(status IN ('DEGRADED', 'UNUSABLE')) THEN 'REQUIRES_DENSE' ELSE 'COMPLETE' END AS cs FROM c GROUP BY recording)
SELECT recording, CASE WHEN cs = 'INCOMPLETE' THEN 'QA_INCOMPLETE' WHEN cs = 'COMPLETE' THEN 'QA_COMPLETE' WHEN recording % 4 = 1 THEN 'QA_INCOMPLETE' WHEN recording % 4 = 0 THEN 'QA_COMPLETE' WHEN recording % 4 = 2 THEN 'QA_INCOMPLETE' ELSE 'DENSE_REQUIRED' END AS status FROM k""")
def a10_completion(spark, d):
    k = quality.coarse_status(_coarse(spark, d), ["recording"], "status")
    open_ = F.col("coarse_status") == "REQUIRES_DENSE"
    dense = F.when(open_ & (F.col("recording") % 4 == 0), "COMPLETE").when(open_ & (F.col("recording") % 4 == 2), "INCOMPLETE")
    failure = F.when(open_ & (F.col("recording") % 4 == 1), "TIMEOUT")
    return k.select("recording", quality.completion(F.col("coarse_status"), dense, failure).alias("status"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'UNAVAILABLE' WHEN l_returnflag = 'R' OR l_linestatus = 'X' THEN 'UNUSABLE' WHEN l_discount > 0.08 OR l_tax > 0.07 THEN 'DEGRADED' WHEN l_discount = 0 OR l_tax = 0 THEN 'UNKNOWN' ELSE 'USABLE' END AS disposition FROM lineitem")
def x6_disposition(spark, d):
    media = F.when(F.col("l_quantity") < 5, "UNAVAILABLE").when(F.col("l_returnflag") == "R", "UNUSABLE").when(F.col("l_discount") > 0.08, "DEGRADED").when(F.col("l_discount") == 0, "UNKNOWN").otherwise("USABLE")
    semantic = F.when(F.col("l_tax") > 0.07, "DEGRADED").when(F.col("l_tax") == 0, "UNKNOWN").otherwise("USABLE")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.disposition(media, semantic).alias("disposition"))


@query(f"WITH {SHOTS}, x AS (SELECT DISTINCT recording, CASE WHEN value > 50 THEN 'semantic:' || label ELSE label END AS code FROM f) SELECT recording, string_agg(code, ',' ORDER BY code) AS codes FROM x GROUP BY recording")
def x7_issue_codes(spark, d):
    g = shots(spark, d).groupBy("recording").agg(F.collect_set(F.when(F.col("value") <= 50, F.col("label"))).alias("m"), F.collect_set(F.when(F.col("value") > 50, F.col("label"))).alias("s"))
    return g.select("recording", F.array_join(quality.issue_codes(F.col("m"), F.col("s")), ",").alias("codes"))


_CLASSES = [f"class_{k:02d}" for k in range(21)]
_CASCADE = f"""WITH {SHOTS}, o AS (SELECT DISTINCT recording, 'class_' || lpad(CAST(event_id % 21 AS VARCHAR), 2, '0') AS class FROM f WHERE value > 120), r AS (SELECT DISTINCT recording FROM f), k AS (SELECT 'class_' || lpad(CAST(unnest(range(21)) AS VARCHAR), 2, '0') AS class),
s AS (SELECT r.recording, k.class, CASE WHEN o.class IS NOT NULL THEN 'OBSERVED' WHEN r.recording % 5 = 0 THEN 'INCOMPLETE_INPUT' WHEN r.recording % 5 = 1 AND k.class = 'class_03' THEN 'INCOMPLETE_INPUT' WHEN r.recording % 7 = 2 THEN 'ABSTAINED' ELSE 'NO_ISSUE' END AS state FROM r CROSS JOIN k LEFT JOIN o ON o.recording = r.recording AND o.class = k.class)"""


def _states(spark, d):
    f = shots(spark, d)
    o = f.filter("value > 120").select("recording", F.concat(F.lit("class_"), F.lpad((F.col("event_id") % 21).cast("string"), 2, "0")).alias("class"))
    none, some = F.expr("cast(array() as array<string>)"), F.array(F.lit("REASON"))
    v = f.select("recording").distinct().select(
        "recording",
        F.when(F.col("recording") % 5 == 1, F.array(F.lit("class_03"))).otherwise(none).alias("incomplete"), F.when(F.col("recording") % 5 < 2, some).otherwise(none).alias("incomplete_reasons"),
        none.alias("abstained"), F.when(F.col("recording") % 7 == 2, some).otherwise(none).alias("abstained_reasons"),
    )
    return quality.class_cascade(o, v, ["recording"], _CLASSES)


@query(f"{_CASCADE} SELECT recording, class, state FROM s")
def x9_class_cascade(spark, d):
    return _states(spark, d)


@query(f"{_CASCADE} SELECT recording, CASE WHEN bool_or(state = 'INCOMPLETE_INPUT') THEN 'INCOMPLETE_INPUT' WHEN bool_or(state = 'ABSTAINED') THEN 'ABSTAINED' ELSE 'COMPLETE' END AS status, count(*) FILTER (state = 'OBSERVED') AS n_observed FROM s GROUP BY recording")
def x9_cascade_status(spark, d):
    return quality.cascade_status(_states(spark, d), ["recording"])


@query(f"WITH {SHOTS}, g AS (SELECT *, lag(start_ns) OVER (PARTITION BY recording, camera ORDER BY event_id) AS p FROM f) SELECT event_id, coalesce(CASE WHEN start_ns < p THEN start_ns END, -1) AS back_from, coalesce(CASE WHEN start_ns < p THEN p END, -1) AS back_to FROM g WHERE start_ns <= p")
def w1_non_monotonic(spark, d):
    return quality.non_monotonic(shots(spark, d), ["recording", "camera"], "event_id", "start_ns").select("event_id", "back_from", "back_to").fillna(-1)


@query(f"WITH {SHOTS}, g AS (SELECT *, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY recording, camera ORDER BY start_ns, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT recording, camera, min(start_ns) AS run_start, max(start_ns) AS run_end, count(*) AS n_rows FROM g WHERE value < 60 GROUP BY recording, camera, run HAVING max(start_ns) - min(start_ns) >= {5 * S}")
def w5_freeze_runs(spark, d):
    return quality.flagged_runs(shots(spark, d), ["recording", "camera"], ["start_ns", "event_id"], F.col("value") < 60, "start_ns", 5 * S)


@query(f"WITH {SHOTS}, g AS (SELECT *, max(start_ns) OVER (PARTITION BY recording, camera ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f) SELECT event_id, p IS NULL OR start_ns > p AS accepted FROM g")
def st4_disorder(spark, d):
    return quality.accepted(shots(spark, d), ["recording", "camera"], "event_id", "start_ns").select("event_id", "accepted")
