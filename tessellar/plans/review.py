"""Review, admission, planning and control over the test tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from ..sources import table
from .registry import SHOTS, S, query, shots

_WHY = "CASE WHEN l_returnflag = 'N' THEN 'NOT_ELIGIBLE' WHEN l_discount = 0 THEN 'MISSING_TERM' WHEN l_tax = 0 THEN 'NOT_APPLICABLE' END"


@query(f"WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {_WHY} AS why FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY why IS NULL ORDER BY l_quantity, l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM w) SELECT l_orderkey, l_linenumber, coalesce(why, CASE WHEN n <= 500 THEN 'SELECTED' ELSE 'BUDGET_EXHAUSTED' END) AS decision FROM r")
def w9_x20_active_learning(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount", "l_tax")
    order = [F.asc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return review.select_within(rows, order, 500, F.col("l_returnflag") != "N", F.col("l_discount") == 0, F.col("l_tax") == 0).select("l_orderkey", "l_linenumber", "decision")


@query("SELECT o_orderkey AS id, o_orderdate < TIMESTAMP '1995-01-01' AS overdue FROM orders WHERE o_orderstatus = 'O'")
def x21_review_queue(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("DONE").alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("due"), F.col("o_custkey").alias("requested"))
    return review.open_queue(t, F.lit("1995-01-01").cast(t.schema["due"].dataType)).select("id", "overdue")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role")
def x22_annotations_in_order(spark, d):
    return table(spark, d, "conversations").orderBy("conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("""WITH a AS (SELECT o_custkey AS id, arg_max(o_totalprice > 50000, o_orderkey) AS ok FROM orders GROUP BY 1), b AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
j AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'SOURCE_NOT_READY' WHEN ok IS NULL THEN 'NO_ALIGNMENT' WHEN NOT ok THEN 'OUTSIDE_COHORT' WHEN s IS NULL THEN 'NO_OUTCOME' WHEN s = 'P' THEN 'NOT_ADMISSIBLE' ELSE 'ADMITTED' END AS reason FROM customer LEFT JOIN a ON a.id = c_custkey LEFT JOIN b ON b.id = c_custkey) SELECT id, reason = 'ADMITTED' AS admitted, reason FROM j""")
def x23_admission(spark, d):
    o = table(spark, d, "orders").withColumn("id", F.col("o_custkey"))
    a = review.latest(o, ["id"], "o_orderkey").select("id", (F.col("o_totalprice") > 50000).alias("in_cohort"))
    b = review.latest(o.filter("o_orderkey % 3 <> 0"), ["id"], "o_orderkey").select("id", F.when(F.col("o_orderstatus") == "P", "REFUSED").otherwise("ADMISSIBLE").alias("outcome"))
    return review.admission(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "NEW").otherwise("READY").alias("state")), a, b)


@query("SELECT c_custkey, c_custkey % 20 AS expected, coalesce(n, 0) AS counted, c_custkey % 20 = coalesce(n, 0) AS whole FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def x24_cohort_reconciliation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 20).alias("expected"))
    return review.reconcile_counts(c, table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


_LOG = f"{SHOTS}, l AS (SELECT recording, event_id, row_number() OVER w - 1 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS seq, md5(CAST(event_id AS VARCHAR)) AS digest, CASE WHEN event_id % 40 = 7 THEN 'x' ELSE lag(md5(CAST(event_id AS VARCHAR))) OVER w END AS parent FROM f WINDOW w AS (PARTITION BY recording ORDER BY event_id))"


@query(f"WITH {_LOG}, g AS (SELECT *, lag(seq) OVER w AS ps, lag(digest) OVER w AS pd FROM l WINDOW w AS (PARTITION BY recording ORDER BY seq, event_id)) SELECT recording, event_id FROM g WHERE NOT CASE WHEN ps IS NULL THEN seq = 0 AND parent IS NULL ELSE seq = ps + 1 AND parent IS NOT DISTINCT FROM pd END")
def x25_w11_chain_breaks(spark, d):
    w = Window.partitionBy("recording").orderBy("event_id")
    f = shots(spark, d).withColumn("digest", F.md5(F.col("event_id").cast("string").cast("binary")))
    log = f.select("recording", "event_id", (F.row_number().over(w) - 1 + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).alias("seq"), "digest", F.when(F.col("event_id") % 40 == 7, "x").otherwise(F.lag("digest").over(w)).alias("parent"))
    return review.chain_breaks(log, ["recording"], "seq", "digest", "parent", "event_id").select("recording", "event_id")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) AS ordinal, md5(CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber) AS digest, l_partkey FROM lineitem), u AS (SELECT l_orderkey, ordinal, min(digest) AS digest, min(l_partkey) AS k FROM p GROUP BY ALL),
g AS (SELECT l_orderkey, count(*) AS n, max(ordinal) = count(*) - 1 AND min(ordinal) = 0 AS contiguous, bool_and(k % 30 <> 0) AS covered FROM u GROUP BY 1) SELECT l_orderkey, n, contiguous, covered, contiguous AND covered AS closed FROM g""")
def x26_x27_sealed_plans(spark, d):
    w = Window.partitionBy("l_orderkey")
    p = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - F.min("l_linenumber").over(w)).alias("ordinal"), F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).cast("binary")).alias("digest"), "l_partkey")
    u = p.groupBy("l_orderkey", "ordinal").agg(F.min("digest").alias("digest"), F.min("l_partkey").alias("k"))
    results = u.filter("k % 30 <> 0 or k % 60 = 0").select("l_orderkey", "ordinal", F.when(F.col("k") % 60 == 0, "other").otherwise(F.col("digest")).alias("digest"))
    return review.sealed(u.drop("k"), results, ["l_orderkey"])


_OFFSETS = [-600 * S, 0, 600 * S]
_NEIGHBOURS = f"""{SHOTS}, b AS (SELECT recording, min(start_ns) AS lo, max(start_ns) AS hi FROM f GROUP BY recording), t AS (SELECT recording, camera, target_ns, count(*) AS n_triggers FROM (SELECT f.recording, camera, start_ns + unnest([{', '.join(map(str, _OFFSETS))}]) AS target_ns, lo, hi FROM f JOIN b ON f.recording = b.recording WHERE label = 'error') WHERE target_ns >= lo AND target_ns < hi GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording, camera ORDER BY target_ns) AS own FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY recording, own <= 20 ORDER BY target_ns, camera) AS n FROM o)"""


@query(f"WITH {_NEIGHBOURS} SELECT recording, camera, target_ns, n_triggers, own <= 20 AND n <= 50 AS kept FROM k")
def w10_x10_neighbour_targets(spark, d):
    f = shots(spark, d)
    b = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi"))
    t = f.filter("label = 'error'").join(b, "recording").withColumn("ts", F.col("start_ns"))
    return review.neighbour_targets(t, ["recording"], _OFFSETS, F.col("lo"), F.col("hi"), 20, 50)


_TRIGGERS = f"{SHOTS}, u AS (SELECT recording, camera, start_ns AS ts, 'FLAG' AS kind FROM f WHERE label = 'error' UNION ALL SELECT recording, camera, start_ns, 'CADENCE' FROM (SELECT *, lag(start_ns) OVER (PARTITION BY recording, camera ORDER BY start_ns) AS p FROM f) WHERE start_ns - p > {86400 * S} UNION ALL SELECT recording, camera, start_ns, 'SEQUENCE' FROM f WHERE event_id % 17 = 0)"


def _triggers(spark, d):
    f = shots(spark, d)
    gap = F.col("start_ns") - F.lag("start_ns").over(Window.partitionBy("recording", "camera").orderBy("start_ns"))
    kinds = [f.filter("label = 'error'").withColumn("kind", F.lit("FLAG")), f.withColumn("_g", gap).filter(F.col("_g") > 86400 * S).drop("_g").withColumn("kind", F.lit("CADENCE")), f.filter("event_id % 17 = 0").withColumn("kind", F.lit("SEQUENCE"))]
    u = [k.select("recording", "camera", F.col("start_ns").alias("ts"), "kind") for k in kinds]
    return u[0].unionByName(u[1]).unionByName(u[2])


@query(f"WITH {_TRIGGERS} SELECT * FROM u")
def x11_quality_triggers(spark, d):
    return _triggers(spark, d)


@query(f"WITH {_TRIGGERS} SELECT recording, camera, ts, kind FROM (SELECT *, row_number() OVER (PARTITION BY recording, camera, ts ORDER BY kind) AS n FROM u) WHERE n = 1")
def x12_first_triggers(spark, d):
    return review.first_triggers(_triggers(spark, d), ["recording", "camera", "ts"], ["kind"])


@query(f"WITH {_TRIGGERS}, b AS (SELECT recording, camera, ts, kind AS reason, 0 AS b FROM u WHERE kind = 'FLAG' UNION ALL SELECT recording, camera, ts, kind, 1 FROM u WHERE kind <> 'FLAG') SELECT recording, camera, ts, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min(b) = 0 AS in_base FROM b GROUP BY ALL")
def u1_u5_union_targets(spark, d):
    u = _triggers(spark, d).withColumnRenamed("kind", "reason")
    return review.union_targets(u.filter("reason = 'FLAG'"), u.filter("reason <> 'FLAG'"), ["recording", "camera", "ts"])


@query(f"WITH {SHOTS} SELECT event_id, CAST((CAST(end_ns - start_ns AS HUGEINT) * 30000 + 1001000000000 - 1) // 1001000000000 AS BIGINT) AS frames FROM f")
def x13_frame_bound(spark, d):
    return shots(spark, d).select("event_id", review.frame_bound(F.col("end_ns") - F.col("start_ns"), 30000, 1001).alias("frames"))


@query(f"""WITH {SHOTS}, n AS (SELECT event_id, start_ns, end_ns, CASE WHEN end_ns - start_ns <= {20 * S} THEN 1 ELSE (end_ns - start_ns - {2 * S} + {18 * S} - 1) // {18 * S} END AS n_parts FROM f), k AS (SELECT *, unnest(range(n_parts)) AS part FROM n)
SELECT event_id, part, n_parts, start_ns + part * {18 * S} AS part_start, least(end_ns, start_ns + part * {18 * S} + {20 * S}) AS part_end FROM k""")
def x14_i6_interval_split(spark, d):
    return review.split_interval(shots(spark, d), "start_ns", "end_ns", 20 * S, 2 * S).select("event_id", "part", "n_parts", "part_start", "part_end")


_METRICS = "m AS (SELECT o_orderkey AS k, o_custkey AS stage, o_orderkey * 100 AS at_ms, CAST(floor(o_totalprice / 1000) AS BIGINT) AS depth, o_custkey * 10 AS oldest_age_ms, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 / 100.0 END AS utilization, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 41 - 20) / 10.0 END AS slope, o_orderkey % 50 AS quota, o_orderkey % 7 AS arrival, o_orderkey % 6 AS service FROM orders)"
_LIMITS = {"depth": 400, "age": 14000, "utilization": 0.98, "slope": 1.9}
_ADMIT = f"{_METRICS}, a AS (SELECT *, concat_ws(',', CASE WHEN depth > 400 THEN 'QUEUE_DEPTH' END, CASE WHEN oldest_age_ms > 14000 THEN 'OLDEST_AGE' END, CASE WHEN utilization >= 0.98 THEN 'WORKER_UTILIZATION' END, CASE WHEN slope > 1.9 THEN 'BACKLOG_SLOPE' END, CASE WHEN quota = 0 THEN 'PROVIDER_QUOTA' END, CASE WHEN arrival > service AND slope > 0 THEN 'ARRIVAL_EXCEEDS_SERVICE' END) AS signals, greatest(CASE WHEN depth > 400 THEN 1000 ELSE 0 END, CASE WHEN oldest_age_ms > 14000 THEN 500 ELSE 0 END, CASE WHEN utilization >= 0.98 THEN 500 ELSE 0 END, CASE WHEN slope > 1.9 THEN 2000 ELSE 0 END, CASE WHEN quota = 0 THEN 1000 ELSE 0 END, CASE WHEN arrival > service AND slope > 0 THEN 1500 ELSE 0 END) AS delay_ms FROM m)"


def _admitted(spark, d):
    k = F.col("o_orderkey")
    m = table(spark, d, "orders").select(
        k.alias("k"), F.col("o_custkey").alias("stage"), (k * 100).alias("at_ms"), F.floor(F.col("o_totalprice") / 1000).alias("depth"), (F.col("o_custkey") * 10).alias("oldest_age_ms"), F.when(k % 3 != 0, k % 100 / 100.0).alias("utilization"),
        F.when(k % 5 != 0, (k % 41 - 20) / 10.0).alias("slope"), (k % 50).alias("quota"), (k % 7).alias("arrival"), (k % 6).alias("service"),
    )
    return review.admit(m, _LIMITS)


@query(f"WITH {_ADMIT} SELECT k, signals, delay_ms, CASE WHEN signals <> '' THEN 'THROTTLED' WHEN depth * 4 >= 1200 OR oldest_age_ms * 4 >= 42000 OR coalesce(slope * 4 >= 3 * 1.9, false) THEN 'ELEVATED' ELSE 'NORMAL' END AS pressure, signals = '' AS admitted FROM a")
def st14_admission_control(spark, d):
    return _admitted(spark, d).select("k", F.array_join("signals", ",").alias("signals"), "delay_ms", "pressure", "admitted")


@query(f"""WITH RECURSIVE {_ADMIT}, o AS (SELECT stage, at_ms, depth, signals = '' AS ok, row_number() OVER (PARTITION BY stage ORDER BY at_ms) AS n, lag(at_ms) OVER (PARTITION BY stage ORDER BY at_ms) AS p FROM a),
r AS (SELECT stage, n, at_ms, depth, ok, CAST(CASE WHEN NOT ok THEN greatest(20, 50) WHEN true THEN least(300, 110) END AS BIGINT) AS lim FROM o WHERE n = 1 UNION ALL SELECT o.stage, o.n, o.at_ms, o.depth, o.ok, CAST(CASE WHEN NOT o.ok THEN greatest(20, CAST(floor(r.lim * 0.5) AS BIGINT)) WHEN o.at_ms >= o.p + 60000 THEN least(300, r.lim + 10) ELSE r.lim END AS BIGINT) FROM o JOIN r ON o.stage = r.stage AND o.n = r.n + 1)
SELECT stage, at_ms, lim AS limit_after, ok AND depth <= lim AS admitted FROM r""")
def st15_aimd(spark, d):
    return review.aimd(_admitted(spark, d).select("stage", "at_ms", "admitted", "depth"), ["stage"], 100, 20, 300, 10, 0.5, 60_000)


@query("SELECT s_suppkey AS stage, round(s_acctbal / (1 + s_nationkey), 6) AS load FROM supplier WHERE s_acctbal > 0")
def st16_fair_dispatch(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stage"), (1 + F.col("s_nationkey")).alias("weight"), F.col("s_acctbal").alias("busy"), F.greatest(F.lit(0.0), F.col("s_acctbal")).alias("queued"))
    return review.fair_load(s, "weight", "busy", "queued").select("stage", F.round("load", 6).alias("load"))


@query("WITH l AS (SELECT o_orderkey, o_orderkey % 8 + 1 AS attempt, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey * 10 END AS e FROM orders) SELECT o_orderkey, CASE WHEN e IS NULL THEN 'FREE' WHEN e > 50000 THEN 'HELD' WHEN attempt >= 6 THEN 'DEAD' ELSE 'RETRY' END AS next, coalesce(CASE WHEN e <= 50000 AND attempt < 6 THEN e + CAST(least(5000, 500 * pow(2, attempt - 1)) AS BIGINT) END, -1) AS retry_at FROM l")
def st17_leases(spark, d):
    l = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8 + 1).alias("attempt"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") * 10).alias("expires_ms"))
    return review.due(l, F.lit(50_000), 500, 5000, 6).select("o_orderkey", "next", F.coalesce("retry_at", F.lit(-1)).alias("retry_at"))
