"""Evidence, boundaries, association and work graphs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association, fusion
from ..sources import table
from .registry import SHOTS, S, query, shots

_WEIGHTS = {"visibility": 0.4, "coverage": 0.3, "reported": 0.1, "qa": 0.2}


@query(f"""WITH {SHOTS}, e AS (SELECT recording, camera, max(value) AS v, count(*) AS n, max(label) AS l FROM f GROUP BY recording, camera),
s AS (SELECT recording, camera, CASE WHEN v > 250 THEN 'SUPPORTING' WHEN v > 150 THEN 'PARTIAL' ELSE 'NONE' END AS status, CASE WHEN n % 3 = 0 THEN 0.0 ELSE least(1.0, v / 400) END AS visibility, least(1.0, n / 100.0) AS coverage, 0.5 AS reported, CASE WHEN n % 2 = 0 THEN 1.0 WHEN n % 5 = 0 THEN 0.7 ELSE 0.0 END AS qa FROM e),
g AS (SELECT recording, sum((0.4e0 * visibility + 0.3e0 * coverage + 0.1e0 * reported + 0.2e0 * qa) * CASE status WHEN 'SUPPORTING' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END) / 6 AS c, count(*) FILTER (status <> 'NONE') AS supporting FROM s GROUP BY recording)
SELECT recording, round(c, 3) AS confidence, supporting, CASE WHEN supporting >= 3 AND c >= 0.3 THEN 'RESOLVED' ELSE concat_ws('+', CASE WHEN supporting < 3 THEN 'INSUFFICIENT_CAMERA_SUPPORT' END, CASE WHEN c < 0.3 THEN 'LOW_UNCALIBRATED_CONFIDENCE' END) END AS ambiguity FROM g""")
def a14_view_fusion(spark, d):
    e = shots(spark, d).groupBy("recording", "camera").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    e = e.select(
        "recording", F.when(F.col("v") > 250, "SUPPORTING").when(F.col("v") > 150, "PARTIAL").otherwise("NONE").alias("status"), F.when(F.col("n") % 3 != 0, F.least(F.lit(1.0), F.col("v") / 400)).alias("visibility"),
        F.least(F.lit(1.0), F.col("n") / 100.0).alias("coverage"), F.lit(0.5).alias("reported"), F.when(F.col("n") % 2 == 0, "GOOD").when(F.col("n") % 5 == 0, "DEGRADED").otherwise("UNKNOWN").alias("quality"),
    )
    return fusion.view_scores(e, ["recording"], _WEIGHTS, 3, 0.3).withColumn("confidence", F.round("confidence", 3))


_OUTCOMES = f"{SHOTS}, c AS (SELECT recording, label, camera, CASE WHEN bool_or(value > 200) THEN 'SUPPORTED' WHEN bool_and(value <= 150) THEN 'NO_ACTION' ELSE 'INDETERMINATE' END AS outcome FROM f GROUP BY recording, label, camera)"


def _outcomes(spark, d):
    status = F.when(F.col("value") > 200, "POSITIVE").when(F.col("value") <= 150, "NO_EVENT").otherwise("UNSURE")
    return fusion.camera_outcome(shots(spark, d).withColumn("status", status), ["recording", "label", "camera"], "status")


@query(f"WITH {_OUTCOMES} SELECT * FROM c")
def x2_camera_outcome(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {_OUTCOMES} SELECT recording, label, CASE WHEN bool_or(outcome = 'SUPPORTED') THEN 'SUPPORTED' WHEN count(*) FILTER (outcome = 'NO_ACTION') = 6 THEN 'NO_ACTION' ELSE 'INDETERMINATE' END AS outcome FROM c GROUP BY recording, label")
def x3_candidate_outcome(spark, d):
    return fusion.candidate_outcome(_outcomes(spark, d), ["recording", "label"])


_ERR = 5 * S


def _role_sql(extra: str = "true") -> str:
    return f"""b AS (SELECT recording, min(start_ns) AS lo, max(start_ns) AS hi FROM f GROUP BY recording),
o AS (SELECT recording, CASE label WHEN 'click' THEN 'ONSET' ELSE 'OFFSET' END AS role, camera, min(greatest(start_ns - {_ERR}, lo)) AS a, max(least(end_ns + {_ERR}, hi)) AS z FROM f JOIN b USING (recording) WHERE label IN ('click', 'view') AND value > 100 GROUP BY ALL),
c AS (SELECT recording, role, camera, a + (z - a) // 2 AS estimate, (z - a + 1) // 2 AS uncertainty FROM o WHERE a < z AND {extra}),
m AS (SELECT recording, role, quantile_disc(estimate, 0.5) AS e, count(*) AS n FROM c GROUP BY recording, role HAVING count(*) >= 3),
r AS (SELECT recording, role, n, e AS estimate, max(abs(estimate - e) + uncertainty) AS uncertainty FROM c JOIN m USING (recording, role) GROUP BY ALL)"""


def _cameras(spark, d):
    f = shots(spark, d)
    b = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi"))
    o = f.filter("label in ('click', 'view') and value > 100").join(b, "recording").withColumn("role", F.when(F.col("label") == "click", "ONSET").otherwise("OFFSET")).withColumn("error", F.lit(_ERR))
    return fusion.camera_boundaries(o, ["recording", "role", "camera"], "start_ns", "end_ns", "error", F.col("lo"), F.col("hi"))


def _roles(spark, d):
    return fusion.role_boundary(_cameras(spark, d), ["recording", "role"], 3)


@query(f"WITH {SHOTS}, {_role_sql()} SELECT recording, role, camera, estimate, uncertainty FROM c")
def a11_camera_boundary(spark, d):
    return _cameras(spark, d).select("recording", "role", "camera", "estimate", "uncertainty")


@query(f"WITH {SHOTS}, {_role_sql()} SELECT recording, role, n, estimate, uncertainty FROM r")
def a12_role_boundary(spark, d):
    return _roles(spark, d)


_ACTION = "a AS (SELECT recording, max(CASE WHEN role = 'ONSET' THEN estimate END) AS onset, max(CASE WHEN role = 'OFFSET' THEN estimate END) AS offs, max(CASE WHEN role = 'ONSET' THEN uncertainty END) AS u, max(CASE WHEN role = 'OFFSET' THEN uncertainty END) AS v FROM r GROUP BY recording), k AS (SELECT *, CASE WHEN onset IS NULL OR offs IS NULL THEN 'MISSING' WHEN onset < offs THEN 'REFINED' ELSE 'CONFLICT' END AS status FROM a)"


@query(f"WITH {SHOTS}, {_role_sql()}, {_ACTION} SELECT recording, coalesce(onset, -1) AS onset, coalesce(offs, -1) AS offset, status, coalesce(onset + u >= offs - v, false) AS overlap FROM k")
def a13_action_boundary(spark, d):
    return fusion.action_boundary(_roles(spark, d), ["recording"], "role").fillna(-1, ["onset", "offset"]).fillna(False, ["overlap"])


@query(f"WITH {SHOTS}, {_role_sql()}, {_ACTION}, p AS (SELECT recording, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM f GROUP BY recording) SELECT p.recording, CASE WHEN status = 'REFINED' THEN onset ELSE start_ns END AS start_ns, CASE WHEN status = 'REFINED' THEN offs ELSE end_ns END AS end_ns, coalesce(status <> 'REFINED', true) AS used_fallback FROM p LEFT JOIN k ON p.recording = k.recording")
def x4_boundary_fallback(spark, d):
    p = shots(spark, d).groupBy("recording").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    return fusion.with_fallback(fusion.action_boundary(_roles(spark, d), ["recording"], "role"), p, ["recording"])


@query(f"WITH {SHOTS}, {_role_sql()}, q AS (SELECT * FROM ({'WITH ' + _role_sql('camera <> 6') + ' SELECT * FROM r'})) SELECT r.recording, r.role, r.uncertainty AS before, coalesce(q.uncertainty, -1) AS after, coalesce(q.uncertainty < r.uncertainty, false) AS narrows FROM r LEFT JOIN q ON r.recording = q.recording AND r.role = q.role")
def x5_boundary_qualification(spark, d):
    """Boundaries with and without the sixth camera."""
    c = _cameras(spark, d)
    return fusion.narrows(fusion.role_boundary(c, ["recording", "role"], 3), fusion.role_boundary(c.filter("camera <> 6"), ["recording", "role"], 3), ["recording", "role"]).fillna(-1, ["after"])


@query(f"""WITH {SHOTS}, x AS (SELECT recording, label, camera, CASE WHEN value > 90 THEN 'SUPPORTS' WHEN value > 60 THEN 'CONTRADICTS' WHEN value > 20 THEN 'NEUTRAL' ELSE 'NOT_OBSERVABLE' END AS relation, CASE WHEN event_id % 4 = 0 THEN 0.8 ELSE least(1.0, value / 100) END AS vis, CASE WHEN event_id % 11 = 0 THEN 'UNUSABLE' WHEN event_id % 3 = 0 THEN 'DEGRADED' ELSE 'USABLE' END AS disp FROM f),
p AS (SELECT recording, label, camera, avg(CASE WHEN relation <> 'NOT_OBSERVABLE' THEN vis * CASE disp WHEN 'USABLE' THEN 1.0 WHEN 'DEGRADED' THEN 0.6 ELSE 0 END END) AS rel, avg(CASE relation WHEN 'SUPPORTS' THEN 1.0 WHEN 'NEUTRAL' THEN 0.5 WHEN 'CONTRADICTS' THEN 0.0 END) AS sup, bool_or(relation <> 'NOT_OBSERVABLE') AS o, bool_or(relation = 'SUPPORTS') AS s, bool_or(relation = 'CONTRADICTS') AS k, bool_or(disp = 'UNUSABLE') AS bad FROM x GROUP BY ALL),
g AS (SELECT recording, label, coalesce(sum(rel * sup) / nullif(sum(rel), 0), 0) AS confidence, count(*) FILTER (o) AS observable, count(*) FILTER (s) AS supporting, count(*) FILTER (k) AS contradicting, bool_or(bad) AS bad FROM p GROUP BY ALL)
SELECT recording, label, round(confidence, 6) AS confidence, observable, supporting, contradicting, concat_ws('+', CASE WHEN contradicting > 0 THEN 'CONTRADICTING_EVIDENCE' END, CASE WHEN observable < 4 THEN 'INSUFFICIENT_OBSERVABLE_CAMERAS' END, CASE WHEN supporting < 3 THEN 'INSUFFICIENT_SUPPORT' END, CASE WHEN confidence < 0.5 THEN 'LOW_CONFIDENCE' END, CASE WHEN bad THEN 'QA_UNUSABLE' END) AS ambiguity, concat_ws('+', CASE WHEN contradicting > 0 THEN 'CONFLICT' END, CASE WHEN bad THEN 'QA' END) AS refine FROM g""")
def a16_perception_fusion(spark, d):
    x = shots(spark, d).select(
        "recording", "label", "camera", F.when(F.col("value") > 90, "SUPPORTS").when(F.col("value") > 60, "CONTRADICTS").when(F.col("value") > 20, "NEUTRAL").otherwise("NOT_OBSERVABLE").alias("relation"),
        F.when(F.col("event_id") % 4 != 0, F.least(F.lit(1.0), F.col("value") / 100)).alias("visibility"), F.when(F.col("event_id") % 11 == 0, "UNUSABLE").when(F.col("event_id") % 3 == 0, "DEGRADED").otherwise("USABLE").alias("disposition"),
    )
    out = fusion.perception_fusion(x, ["recording", "label"], {"SUPPORTS": 1.0, "NEUTRAL": 0.5, "CONTRADICTS": 0.0}, {"USABLE": 1.0, "DEGRADED": 0.6}, 0.8, 4, 3, 0.5)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(None)
def i5_adjudication(spark, d):
    f = shots(spark, d).filter("label = 'purchase'")
    rows = f.select("recording", F.col("event_id").alias("id"), "start_ns", (F.col("start_ns") + (F.col("end_ns") - F.col("start_ns")) * 20).alias("end_ns"), F.round(F.least(F.lit(1.0), F.col("value") / 200), 2).alias("confidence"), (F.col("event_id") % 13 != 0).alias("resolved"))
    return fusion.adjudicate(rows, "recording", 0.02)


@query(None)
def st12_tracks(spark, d):
    """Tracks of each recording's events, a step an hour."""
    f = shots(spark, d)
    return fusion.tracks(f.select("recording", F.expr("start_ns div 3600000000000").alias("step"), F.col("event_id").alias("id"), "label", "start_ns", "end_ns"), "recording", 3600 * S)


# a pair lies within two hours; its shared cameras and bridges are told by the ids
_GAP = 7200 * S
_PAIRS = f"{SHOTS}, g AS (SELECT * FROM f WHERE value > 60), p AS (SELECT a.recording, a.event_id AS a_id, b.event_id AS b_id, a.label AS a_label, b.label AS b_label, greatest(0, greatest(a.start_ns, b.start_ns) - least(a.end_ns, b.end_ns)) AS gap_ns FROM g a JOIN g b ON a.recording = b.recording AND a.event_id < b.event_id AND a.start_ns - {_GAP} <= b.end_ns AND b.start_ns <= a.end_ns + {_GAP})"


def _pairs(spark, d):
    rows = shots(spark, d).filter("value > 60").select("recording", F.col("event_id").alias("id"), "label", "start_ns", "end_ns")
    return association.near_pairs(rows, ["recording"], _GAP, _GAP).select("recording", "a_id", "b_id", "a_label", "b_label", "gap_ns")


@query(f"WITH {_PAIRS} SELECT recording, a_id, b_id, gap_ns FROM p")
def j6_near_pairs(spark, d):
    return _pairs(spark, d).select("recording", "a_id", "b_id", "gap_ns")


_EVIDENCE = "e AS (SELECT event_id AS id, CAST(event_id % 6 + 1 AS INTEGER) AS camera, CAST(floor(value * 4000) AS BIGINT) AS confidence FROM g UNION ALL SELECT event_id, CAST(event_id // 6 % 6 + 1 AS INTEGER), CAST(floor(value * 3000) AS BIGINT) FROM g UNION ALL SELECT event_id, 1, 500000 FROM g WHERE event_id % 2 = 0), t AS (SELECT id, camera, max(confidence) AS c FROM e WHERE confidence >= 200000 GROUP BY ALL)"
_CONFIDENT = f"{_PAIRS}, {_EVIDENCE}, q AS (SELECT a_id, b_id, min(least(x.c, y.c)) AS confidence, count(*) AS n_shared FROM p JOIN t x ON x.id = a_id JOIN t y ON y.id = b_id AND y.camera = x.camera GROUP BY ALL), z AS (SELECT p.*, q.confidence, coalesce(q.n_shared, 0) AS n_shared FROM p LEFT JOIN q ON p.a_id = q.a_id AND p.b_id = q.b_id)"


def _confident(spark, d):
    g = shots(spark, d).filter("value > 60")
    one = g.select(F.col("event_id").alias("id"), (F.col("event_id") % 6 + 1).cast("int").alias("camera"), F.floor(F.col("value") * 4000).alias("confidence"))
    two = g.select(F.col("event_id").alias("id"), F.expr("cast(event_id div 6 % 6 + 1 as int)").alias("camera"), F.floor(F.col("value") * 3000).alias("confidence"))
    three = g.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit(1).alias("camera"), F.lit(500000).cast("long").alias("confidence"))
    return association.pair_confidence(_pairs(spark, d), one.unionByName(two).unionByName(three), 200000)


@query(f"WITH {_CONFIDENT} SELECT a_id, b_id, n_shared, coalesce(confidence, -1) AS confidence FROM z")
def x16_pair_confidence(spark, d):
    return _confident(spark, d).select("a_id", "b_id", "n_shared", "confidence").fillna(-1)


_CLASSIFIED = f"""{_CONFIDENT}, br AS (SELECT a_id, b_id, CASE WHEN (a_id + b_id) % 2 = 0 THEN 'GAP_CONTINUITY' ELSE 'LABEL_TRANSITION' END AS kind, CAST((a_id * 7 + b_id) % 10 * 100000 AS BIGINT) AS confidence FROM z UNION ALL SELECT a_id, b_id, 'GAP_CONTINUITY', 700000 FROM z WHERE b_id % 3 = 0),
bb AS (SELECT z.a_id, z.b_id, max(br.confidence) AS top, count(*) FILTER (br.confidence >= 300000) AS able, arg_max(br.confidence, br.confidence) AS x, list(br.confidence) AS allc FROM z JOIN br ON z.a_id = br.a_id AND z.b_id = br.b_id AND br.kind = CASE WHEN a_label <> b_label THEN 'LABEL_TRANSITION' ELSE 'GAP_CONTINUITY' END GROUP BY ALL),
y AS (SELECT z.*, top, coalesce(able, 0) AS able, len(list_filter(allc, lambda c: c = top)) AS ties FROM z LEFT JOIN bb ON z.a_id = bb.a_id AND z.b_id = bb.b_id),
w AS (SELECT *, CASE WHEN gap_ns = 0 AND a_label = b_label AND n_shared = 0 THEN 'INSUFFICIENT_SHARED_CAMERA_SUPPORT' WHEN gap_ns = 0 AND a_label = b_label THEN 'TOUCHING_OR_OVERLAPPING_SHARED_CAMERA' WHEN gap_ns > {3600 * S} THEN 'GAP_EXCEEDS_POLICY' WHEN n_shared = 0 THEN 'INSUFFICIENT_SHARED_CAMERA_SUPPORT' WHEN able = 0 AND a_label <> b_label THEN 'LABEL_TRANSITION_REQUIRES_BRIDGE_EVIDENCE' WHEN able = 0 THEN 'GAP_REQUIRES_BRIDGE_EVIDENCE' WHEN a_label <> b_label THEN 'LABEL_TRANSITION_EVIDENCE' ELSE 'GAP_CONTINUITY_EVIDENCE' END AS reason FROM y),
v AS (SELECT *, CASE WHEN reason IN ('LABEL_TRANSITION_EVIDENCE', 'GAP_CONTINUITY_EVIDENCE') THEN CASE WHEN ties > 1 THEN 'AMBIGUOUS' ELSE 'MERGED' END WHEN reason = 'TOUCHING_OR_OVERLAPPING_SHARED_CAMERA' THEN 'MERGED' ELSE 'SPLIT' END AS disposition FROM w)"""


def _classified(spark, d):
    z = _confident(spark, d)
    kind = F.when((F.col("a_id") + F.col("b_id")) % 2 == 0, "GAP_CONTINUITY").otherwise("LABEL_TRANSITION")
    br = z.select("a_id", "b_id", kind.alias("kind"), ((F.col("a_id") * 7 + F.col("b_id")) % 10 * 100000).alias("confidence"))
    br = br.unionByName(z.filter("b_id % 3 = 0").select("a_id", "b_id", F.lit("GAP_CONTINUITY").alias("kind"), F.lit(700000).cast("long").alias("confidence")))
    return association.classify(z, br, 3600 * S, True, 300000)


@query(f"WITH {_CLASSIFIED} SELECT a_id, b_id, disposition, reason FROM v")
def x15_pair_classification(spark, d):
    return _classified(spark, d).select("a_id", "b_id", "disposition", "reason")


@query(f"WITH {_CLASSIFIED}, s AS (SELECT a_id, b_id, top AS c, a_id AS m, 'LATER' AS side FROM v WHERE reason IN ('LABEL_TRANSITION_EVIDENCE', 'GAP_CONTINUITY_EVIDENCE') UNION ALL SELECT a_id, b_id, top, b_id, 'EARLIER' FROM v WHERE reason IN ('LABEL_TRANSITION_EVIDENCE', 'GAP_CONTINUITY_EVIDENCE')), tt AS (SELECT *, max(c) OVER (PARTITION BY m, side) AS best FROM s), u AS (SELECT *, count(*) OVER (PARTITION BY m, side) AS n FROM tt WHERE c = best) SELECT DISTINCT a_id, b_id FROM u WHERE n > 1")
def i3_ambiguous_bridges(spark, d):
    e = _classified(spark, d).filter("reason in ('LABEL_TRANSITION_EVIDENCE', 'GAP_CONTINUITY_EVIDENCE')")
    return association.ambiguous_sides(e.select("a_id", "b_id", F.col("edge_confidence").alias("confidence")))


@query(None)
def i2_x17_clusters(spark, d):
    merged = _classified(spark, d).filter("disposition = 'MERGED'").select("a_id", "b_id", F.col("edge_confidence").alias("confidence"))
    rows = shots(spark, d).filter("value > 60").select(F.col("event_id").alias("id"), "label", "start_ns", "end_ns")
    return association.clusters(rows.join(association.components(merged.select("a_id", "b_id"), rows.select("id")), "id"), merged)


@query(f"""WITH RECURSIVE v AS (SELECT c_custkey AS id, 'n' || c_nationkey || c_mktsegment AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 's' || CAST(floor(c_acctbal) AS BIGINT) FROM customer WHERE c_acctbal > 9000),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM v a JOIN v b ON a.k = b.k), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS id, min(y) AS component FROM r GROUP BY x""")
def i4_leakage_groups(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("n"), F.floor("c_acctbal").alias("s"))
    return association.shared_groups(c, "c_custkey", ["n", "s"])


@query("""WITH f AS (SELECT p_partkey AS id, p_brand AS c FROM part), t AS (SELECT p_partkey AS id, p_brand || p_type AS c FROM part WHERE p_partkey % 10 <> 3), tp AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM f JOIN t USING (id) GROUP BY f.c, t.c)), p AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM f GROUP BY c)), q AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM t GROUP BY c))
SELECT CAST(tp.n AS BIGINT) AS tp, CAST(p.n - tp.n AS BIGINT) AS fp, CAST(q.n - tp.n AS BIGINT) AS fn, CAST(tp.n * 1000000 // p.n AS BIGINT) AS precision, CAST(tp.n * 1000000 // q.n AS BIGINT) AS recall FROM tp, p, q""")
def a42_x18_pair_metrics(spark, d):
    p = table(spark, d, "part")
    return association.pair_metrics(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")), p.filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("cluster")))


_ITEMS = "i AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderkey % 40 = 7 THEN 'FAILED' ELSE 'PENDING' END AS state FROM orders), n AS (SELECT id AS down, id // 2 AS up, id % 5 <> 0 AS required FROM i WHERE id // 2 <> id AND id // 2 IN (SELECT id FROM i))"


@query(f"""WITH RECURSIVE {_ITEMS}, lost AS (SELECT id FROM i WHERE state = 'FAILED' UNION SELECT n.down FROM lost JOIN n ON n.up = lost.id AND n.required JOIN i ON i.id = n.down AND i.state = 'PENDING'),
s AS (SELECT id, CASE WHEN id IN (SELECT id FROM lost) THEN 'FAILED' ELSE state END AS state FROM i), w AS (SELECT DISTINCT n.down AS id FROM n JOIN s ON s.id = n.up AND s.state = 'PENDING') SELECT s.id, CASE WHEN state = 'PENDING' AND w.id IS NULL THEN 'READY' ELSE state END AS state FROM s LEFT JOIN w ON s.id = w.id""")
def i7_failure_propagation(spark, d):
    o = table(spark, d, "orders")
    i = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderkey") % 40 == 7, "FAILED").otherwise("PENDING").alias("state"))
    n = i.select(F.col("id").alias("downstream"), F.expr("id div 2").alias("upstream"), (F.col("id") % 5 != 0).alias("required")).filter("upstream <> downstream")
    return association.propagate(i, n)


@query("""WITH m AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'SKIPPED' END END AS o, CASE WHEN o_orderkey % 4 = 0 THEN 'REQUIRED' ELSE 'DEGRADABLE' END AS c FROM orders),
g AS (SELECT k, count(*) FILTER (o IN ('SUCCEEDED', 'SKIPPED')) AS good, count(*) FILTER (o = 'FAILED') AS failed, count(*) FILTER (o = 'FAILED' AND c = 'DEGRADABLE') AS degraded, count(*) FILTER (c = 'REQUIRED' AND o NOT IN ('SUCCEEDED', 'SKIPPED')) AS lost, count(*) FILTER (o <> 'PENDING') AS ended FROM m GROUP BY k),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 + c_custkey % 6 END AS expected, coalesce(good, 0) AS good, coalesce(failed, 0) AS failed, coalesce(degraded, 0) AS degraded, coalesce(lost, 0) AS lost, coalesce(ended, 0) AS ended FROM customer LEFT JOIN g ON k = c_custkey)
SELECT c_custkey, CASE WHEN expected = 0 THEN 'SKIPPED' WHEN ended < expected THEN 'PENDING' WHEN lost = 0 AND good >= 2 AND degraded <= 3 THEN 'SUCCEEDED' ELSE 'INCOMPLETE' END AS overall_status, CASE WHEN expected = 0 THEN 0 ELSE degraded END AS degraded, CASE WHEN expected = 0 THEN 0 ELSE failed END AS failed, expected = 0 OR ended >= expected AS is_complete FROM b""")
def a20_barrier_policy(spark, d):
    o = table(spark, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").when(F.col("o_orderkey") % 3 == 0, "PENDING").otherwise("SKIPPED")
    m = o.select(F.col("o_custkey").alias("c_custkey"), outcome.alias("outcome"), F.when(F.col("o_orderkey") % 4 == 0, "REQUIRED").otherwise("DEGRADABLE").alias("criticality"))
    b = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit(0)).otherwise(1 + F.col("c_custkey") % 6).alias("expected"), F.lit("SKIPPED").alias("empty_semantics"), F.lit(2).alias("least_success"), F.lit(3).alias("most_degraded"))
    return association.barrier(m, b, "c_custkey")
