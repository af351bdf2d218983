"""Stream rules as batch queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion, windows
from ..sources import table
from .registry import SHOTS, S, query, shots

_LATE = 300_000_000
_SO_FAR = "OVER (PARTITION BY recording ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {SHOTS}, m AS (SELECT event_id, {', '.join(f'max(CASE WHEN camera = {c} THEN start_ns END) {_SO_FAR} AS m{c}' for c in range(1, 7))} FROM f) SELECT event_id, coalesce(CASE WHEN {' AND '.join(f'm{c} IS NOT NULL' for c in range(1, 7))} THEN least({', '.join(f'm{c}' for c in range(1, 7))}) - {_LATE} END, -1) AS watermark FROM m")
def st1_watermark(spark, d):
    return windows.watermark(shots(spark, d), ["recording"], "camera", "event_id", "start_ns", _LATE, 6).select("event_id", F.coalesce("watermark", F.lit(-1)).alias("watermark"))


@query(f"WITH {SHOTS}, a AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS size FROM f), k AS (SELECT event_id, recording, camera, start_ns, size FROM a QUALIFY max(start_ns) OVER (PARTITION BY recording, camera) - start_ns <= {7 * 86400 * S}) SELECT event_id, recording, camera FROM k QUALIFY sum(size) OVER (PARTITION BY recording, camera ORDER BY start_ns DESC, event_id DESC ROWS UNBOUNDED PRECEDING) <= 50000")
def st5_ring_buffer(spark, d):
    f = shots(spark, d).withColumn("size", F.floor(F.col("value") * 100))
    return windows.ring(f, ["recording", "camera"], ["start_ns", "event_id"], "start_ns", "size", 7 * 86400 * S, 50_000).select("event_id", "recording", "camera")


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_id FROM events), k AS (SELECT * FROM r WHERE event_id % 29 <> 3) SELECT user_id, ordinal, event_id FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ordinal) - 1 = ordinal")
def st10_closed_prefix(spark, d):
    r = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("ordinal"), "event_id")
    return windows.closed_prefix(r.filter("event_id % 29 <> 3"), ["user_id"], "ordinal")


@query("WITH d AS (SELECT o_orderkey AS k, o_orderdate AS sealed FROM orders WHERE o_orderstatus <> 'P') SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN sealed IS NULL THEN 'PENDING' WHEN l_shipdate < sealed THEN 'APPLIED' ELSE 'AUDIT_ONLY' END AS effect FROM lineitem LEFT JOIN d ON k = l_orderkey")
def st11_late_feedback(spark, d):
    dec = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("sealed"))
    return windows.late_feedback(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), dec, ["l_orderkey"], "l_shipdate", "sealed")


@query("WITH g AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, first(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CASE WHEN n = 1 THEN 'APPLIED' WHEN event_type = f THEN 'REPLAY' ELSE 'CONFLICT' END AS effect FROM g")
def st13_replays(spark, d):
    return windows.replayed(table(spark, d, "events"), "user_id", "event_type", "event_id").select("event_id", "effect")


@query("WITH RECURSIVE o AS (SELECT conv_id, turn, sha256(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations), c AS (SELECT conv_id, n, k, sha256(sha256('') || digest) AS root FROM o WHERE n = 1 UNION ALL SELECT o.conv_id, o.n, o.k, sha256(c.root || o.digest) FROM o JOIN c ON o.conv_id = c.conv_id AND o.n = c.n + 1) SELECT conv_id, k AS n, root FROM c WHERE n = k")
def w12_hash_chain(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    return windows.hash_chain(c, ["conv_id"], "turn", "digest")


@query(f"""WITH {SHOTS}, i AS (SELECT *, sum(o) OVER w AS island FROM (SELECT *, CASE WHEN start_ns > max(end_ns) OVER (PARTITION BY recording, label ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {600 * S} OR row_number() OVER (PARTITION BY recording, label ORDER BY start_ns, end_ns) = 1 THEN 1 ELSE 0 END AS o FROM f) WINDOW w AS (PARTITION BY recording, label ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING))
SELECT recording, label, CAST(island AS BIGINT) AS island, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_parts, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, CASE WHEN count(DISTINCT camera) < 2 THEN 'SINGLE_CAMERA' ELSE 'RESOLVED' END AS ambiguity FROM i GROUP BY recording, label, island""")
def a17_provisional_actions(spark, d):
    return fusion.provisional_actions(shots(spark, d), ["recording", "label"], 600 * S, 2)
