"""Retrieval, joins, identity and scalar functions over the test tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..operators import joins, retrieval, timegrid
from ..sources import fixtures, table
from .registry import SHOTS, S, query, shots

_ROWS = f"{SHOTS}, s AS (SELECT event_id, recording, label, start_ns, end_ns + 1 AS end_ns, CASE WHEN event_id % 4 <> 0 THEN least(1.0, value / 200) END AS confidence, CASE WHEN value > 30 THEN 'PASS' ELSE 'FAIL' END AS s1, CASE WHEN camera > 3 THEN 'SUPPORTING' ELSE 'NONE' END AS s2, CASE WHEN event_id % 3 = 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS s3 FROM f), n AS (SELECT *, CAST(s1 = 'PASS' AS INTEGER) + CAST(s2 = 'SUPPORTING' AS INTEGER) + CAST(s3 = 'PARTIAL' AS INTEGER) AS usable FROM s)"


def _rows(spark, d):
    f = shots(spark, d)
    statuses = F.create_map(F.lit("c1"), F.when(F.col("value") > 30, "PASS").otherwise("FAIL"), F.lit("c2"), F.when(F.col("camera") > 3, "SUPPORTING").otherwise("NONE"), F.lit("c3"), F.when(F.col("event_id") % 3 == 0, "PARTIAL").otherwise("UNKNOWN"))
    rows = f.select("event_id", "recording", "label", "start_ns", (F.col("end_ns") + 1).alias("end_ns"), F.when(F.col("event_id") % 4 != 0, F.least(F.lit(1.0), F.col("value") / 200)).alias("confidence"), statuses.alias("camera_statuses"))
    return retrieval.normalise(rows, "camera_statuses", ["label", "recording"])


@query(f"WITH {_ROWS} SELECT event_id, usable AS usable_camera_count, label || ' ' || recording AS search_text FROM n")
def p2_event_rows(spark, d):
    return _rows(spark, d).select("event_id", "usable_camera_count", "search_text")


_T0 = 1_704_500_000 * S
_FILTERS = {"equal": {"label": "click"}, "start_min": _T0, "end_max": _T0 + 15 * 86400 * S, "min_confidence": 0.1, "min_usable": 2, "statuses": {"c1": "PASS"}}
_WHERE = f"label = 'click' AND start_ns >= {_T0} AND end_ns <= {_T0 + 15 * 86400 * S} AND confidence >= 0.1 AND usable >= 2 AND s1 = 'PASS'"


@query(f"WITH {_ROWS} SELECT event_id FROM n WHERE {_WHERE}")
def p1_r4_structured_query(spark, d):
    return _rows(spark, d).filter(retrieval.matches(_FILTERS)).select("event_id")


@query(f"WITH {_ROWS}, m AS (SELECT *, count(*) OVER () AS total FROM n WHERE {_WHERE}) SELECT event_id, confidence, total, total > 60 AS has_more FROM m ORDER BY confidence DESC, start_ns, event_id LIMIT 40 OFFSET 20")
def t1_counted_page(spark, d):
    rows = _rows(spark, d).filter(retrieval.matches(_FILTERS))
    return retrieval.counted_page(rows, [F.desc("confidence"), F.asc("start_ns"), F.asc("event_id")], 20, 40).select("event_id", "confidence", "total", "has_more")


@query("WITH c AS (SELECT o_orderkey AS id, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 1000), h AS (SELECT l_orderkey AS id, max(l_discount - l_tax) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), r AS (SELECT c.id, s, row_number() OVER (ORDER BY coalesce(s, -1) DESC, place) AS n FROM c LEFT JOIN h ON c.id = h.id) SELECT id, round(coalesce(s, -9), 6) AS semantic_score FROM r WHERE n > 10 AND n <= 110")
def r7_rerank(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    h = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") - F.col("l_tax")).alias("score"))
    return retrieval.rerank(c, h, [F.desc("o_totalprice"), F.asc("id")], 10, 100).select("id", F.round(F.coalesce("semantic_score", F.lit(-9.0)), 6).alias("semantic_score"))


@query("WITH c AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10) SELECT id FROM c")
def r8_structured_fallback(spark, d):
    """The page when vectors fail: the structured one."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return retrieval.rerank(c, None, [F.desc("o_totalprice"), F.asc("id")], 10, 100).select("id")


_Q = [round(0.1 * (k % 7) - 0.3, 3) for k in range(64)]


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE label % 2 = 0 AND label % 3 <> 0 AND vec_id IN (SELECT doc_id FROM labels)) SELECT id, round(list_cosine_similarity(e, list_transform(range(len(e)), lambda k: round(0.1 * (k % 7) - 0.3, 3)::DOUBLE)), 6) AS score FROM v WHERE list_cosine_similarity(e, list_transform(range(len(e)), lambda k: round(0.1 * (k % 7) - 0.3, 3)::DOUBLE)) >= 0.02 ORDER BY list_cosine_similarity(e, list_transform(range(len(e)), lambda k: round(0.1 * (k % 7) - 0.3, 3)::DOUBLE)) DESC, id LIMIT 30")
def r6_j15_vector_search(spark, d):
    e = table(spark, d, "embeddings")
    n = len(e.select("embedding").first()[0])
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "READY").otherwise("PENDING").alias("state"), F.when(F.col("label") % 3 != 0, "a").otherwise("b").alias("tenant"))
    c = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return retrieval.vector_search(v, [round(0.1 * (k % 7) - 0.3, 3) for k in range(n)], F.lit("a"), c, 0.02, 30).select("id", F.round("score", 6).alias("score"))


@query("WITH s AS (SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR) || '/' || turn) AS rev FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT s.conv_id, c.role, length(c.text) AS n FROM s JOIN conversations c ON s.conv_id = c.conv_id AND s.turn = c.turn")
def r1_index_build(spark, d):
    """The current revision of each conversation: the one selected last."""
    c = table(spark, d, "conversations").withColumn("rev", F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")))
    s = c.select("conv_id", "rev", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("seq"))
    r = c.select("rev", "role", "text", F.sha2("text", 256).alias("digest"))
    return retrieval.build_index(r, s, "conv_id", "rev", "seq", "digest").select("conv_id", "role", F.length("text").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def r2_r3_append(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    there = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    return retrieval.append(there, docs, "doc_id", "digest").select("doc_id")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (source = 'web') > 0 AND lang = 'en' AS reused FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def r10_identity(spark, d):
    """Documents of one language and source are one event; that of English pages of the web is known."""
    docs = table(spark, d, "documents").filter("lang is not null and source is not null")
    known = docs.filter("lang = 'en' and source = 'web'").select(fn.length_prefixed(F.col("lang"), F.col("source")).alias("key"), F.lit("known").alias("event_id")).distinct()
    out = retrieval.resolve_identity(docs.select("lang", "source"), known, ["lang", "source"], "tessellar:test")
    return out.groupBy("lang", "source").agg(F.count("*").alias("n"), (F.bool_or("reused") & (F.countDistinct("event_id") == 1)).alias("reused"))


@query(f"""WITH {SHOTS}, a AS (SELECT recording, event_id AS id, start_ns AS s, end_ns AS e FROM f WHERE event_id % 2 = 0), b AS (SELECT recording, event_id AS id, start_ns - 60000000000 * (event_id % 9) AS s, end_ns + 30000000000 AS e FROM f WHERE event_id % 2 = 1 UNION ALL SELECT recording, event_id + 1000000000, start_ns, end_ns FROM f WHERE event_id % 20 = 0),
h AS (SELECT a.id AS old_id, b.id AS new_id, a.s = b.s AND a.e = b.e AS same FROM a JOIN b ON a.recording = b.recording AND a.s < b.e AND b.s < a.e), c AS (SELECT *, count(*) OVER (PARTITION BY old_id) AS o, count(*) OVER (PARTITION BY new_id) AS n FROM h)
SELECT old_id, new_id, CASE WHEN o > 1 THEN 'SPLIT' WHEN n > 1 THEN 'MERGE' WHEN same THEN 'SUPERSEDES' ELSE 'POSSIBLE_MATCH' END AS relation FROM c""")
def r11_identity_relations(spark, d):
    f = shots(spark, d).withColumnRenamed("event_id", "id")
    a = f.filter("id % 2 = 0").select("recording", "id", "start_ns", "end_ns")
    b = f.filter("id % 2 = 1").select("recording", "id", (F.col("start_ns") - F.col("id") % 9 * 60 * S).alias("start_ns"), (F.col("end_ns") + 30 * S).alias("end_ns"))
    b = b.unionByName(f.filter("id % 20 = 0").select("recording", (F.col("id") + 1_000_000_000).alias("id"), "start_ns", "end_ns"))
    return retrieval.identity_relations(a, b, ["recording"])


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'PENDING' ELSE 'RETRY' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality <> 1")
def r9_embedding_queue(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "READY").otherwise("FAILED").alias("state"))
    return retrieval.embedding_queue(table(spark, d, "documents").select("doc_id"), done, "doc_id").select("doc_id", "state")


_STEP, _TOL = 21_600 * S, 7_200 * S


@query(f"""WITH {SHOTS}, b AS (SELECT recording, min(start_ns) AS lo, max(start_ns) + 1 AS hi FROM f GROUP BY recording), t AS (SELECT recording, k, k * {_STEP} AS target_ns FROM (SELECT recording, lo, hi, unnest(generate_series(lo // {_STEP}, hi // {_STEP} + 1)) AS k FROM b) WHERE k * {_STEP} >= lo AND k * {_STEP} < hi),
m AS (SELECT t.recording, t.k, t.target_ns, f.camera, arg_min(start_ns, abs(start_ns - t.target_ns) * 2 + CASE WHEN start_ns > t.target_ns THEN 1 ELSE 0 END) AS ns FROM t JOIN f ON f.recording = t.recording AND abs(start_ns - t.target_ns) <= {_TOL} GROUP BY ALL),
g AS (SELECT recording, k, count(*) AS n, max(ns) - min(ns) AS skew FROM m GROUP BY ALL) SELECT t.recording, t.k, t.target_ns, coalesce(n, 0) AS n_cameras, coalesce(CASE WHEN n = 6 THEN skew END, -1) AS skew_ns FROM t LEFT JOIN g ON t.recording = g.recording AND t.k = g.k""")
def j4_camera_skew(spark, d):
    f = shots(spark, d)
    spans = f.groupBy("recording").agg(F.min("start_ns").alias("lo"), (F.max("start_ns") + 1).alias("hi"))
    t = timegrid.grid_targets(spans, ["recording"], "lo", "hi", _STEP, 1)
    return joins.camera_skew(t, f.select("recording", "camera", F.col("start_ns").alias("frame_ns")), ["recording"], 6, _TOL).fillna(-1, ["skew_ns"])


@query(f"WITH {SHOTS}, o AS (SELECT recording, camera, start_ns, row_number() OVER (PARTITION BY recording, camera ORDER BY event_id) AS ordinal FROM f) SELECT a.recording, a.ordinal, a.start_ns AS a, b.start_ns AS b FROM o a JOIN o b ON a.recording = b.recording AND a.ordinal = b.ordinal AND a.camera = 1 AND b.camera = 2")
def j5_pair_by_ordinal(spark, d):
    f = shots(spark, d)
    return joins.pair_by_ordinal(f.filter("camera = 1"), f.filter("camera = 2"), ["recording"], "event_id", "start_ns")


@query("SELECT c_custkey, c_acctbal, n FROM customer JOIN (SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON k = c_custkey")
def j8_exact_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    n = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return joins.exact_join(c, n, ["c_custkey"])


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def j14_p9_rejected_outputs(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("token"))
    return joins.rejected_outputs(refs, table(spark, d, "part").filter("p_size > 3").select(F.col("p_partkey").alias("token")), "token", "l_orderkey")


@query("SELECT l_orderkey AS downstream, count(*) AS n, bool_and(p_size > 10) AS all_done, bool_or(p_size < 3) AS any_failed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j10_dependency_states(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, "SUCCEEDED").when(F.col("p_size") < 3, "FAILED").otherwise("RUNNING").alias("state"))
    return joins.upstream_states(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("downstream"), F.col("l_partkey").alias("upstream")), items)


@query("SELECT c_custkey, o_orderkey, coalesce(l_linenumber, -1) AS l_linenumber, l_shipdate FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey WHERE c_acctbal > 8000")
def j13_evidence_chain(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 8000").select("c_custkey")
    j = c.join(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_shipdate")
    return j.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").orderBy(F.desc_nulls_last("l_shipdate")).select("c_custkey", "o_orderkey", F.coalesce("l_linenumber", F.lit(-1)).alias("l_linenumber"), "l_shipdate")


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def u6_u7_active_subjects(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).union(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")).distinct()


@query("SELECT recording, string_agg(DISTINCT label, ',' ORDER BY label) = 'click,error,purchase,signup,view' AS same FROM (SELECT user_id // 6 AS recording, event_type AS label FROM events WHERE value > 90) GROUP BY recording")
def u3_set_equality(spark, d):
    want = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return shots(spark, d).filter("value > 90").groupBy("recording").agg((F.array_sort(F.collect_set("label")) == want).alias("same"))


@query("""WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), j AS (SELECT event_id, k AS x, k + CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 3 END AS y FROM a) SELECT event_id, 'k' AS path, CASE WHEN y IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind FROM j WHERE y IS NULL OR abs(x - y) > 1""")
def p14_x32_json_diff(spark, d):
    """Events' properties beside altered ones: numbers within 1 are equal, `trace` is ignored."""
    e = table(spark, d, "events").select("event_id", "props")
    a = joins.flatten(e, "event_id", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    more = F.when(F.col("event_id") % 4 == 0, k).when(F.col("event_id") % 4 == 1, k + 0.5).when(F.col("event_id") % 4 == 2, k + 3)
    b = joins.flatten(e.select("event_id", F.to_json(F.struct(more.alias("k"), F.lit("x").alias("trace"))).alias("props")), "event_id", "props")
    return joins.map_diff(a, b, "event_id", "path", "leaf", {"": 0.0, "k": 1.0}, ["trace"])


@query("SELECT a.l_orderkey, a.l_linenumber, concat_ws(',', CASE WHEN l_returnflag <> 'N' THEN 'flag' END, CASE WHEN l_tax <> l_discount THEN 'rate' END, CASE WHEN l_partkey % 2 <> l_suppkey % 2 THEN 'parity' END) AS reasons FROM lineitem a")
def p13_mismatch_reasons(spark, d):
    c = F.col
    r = joins.mismatch_reasons({"flag": (c("l_returnflag"), F.lit("N")), "rate": (c("l_tax"), c("l_discount")), "parity": (c("l_partkey") % 2, c("l_suppkey") % 2)})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(r, ",").alias("reasons"))


@query("SELECT event_id, round(CASE WHEN value <= 10 THEN 0.05 WHEN value <= 50 THEN 0.05 + (value - 10) * 0.3 / 40 WHEN value <= 200 THEN 0.35 + (value - 50) * 0.6 / 150 ELSE 0.95 END, 6) AS calibrated FROM events")
def p12_isotonic(spark, d):
    return table(spark, d, "events").select("event_id", F.round(joins.isotonic(F.col("value"), [(10, 0.05), (50, 0.35), (200, 0.95)]), 6).alias("calibrated"))


@query("SELECT event_id, nullif(trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE '  ' || event_type || ' ' END), '') AS label FROM events")
def p5_labels(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return table(spark, d, "events").select("event_id", F.nullif(F.trim(raw), F.lit("")).alias("label"))


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'error' OR value IS NULL OR value < 1 OR (event_type = 'view' AND value > 150) OR event_id % 97 = 0")
def p11_hard_cases(spark, d):
    c = F.col
    hard = (c("event_type") == "error") | c("value").isNull() | (c("value") < 1) | ((c("event_type") == "view") & (c("value") > 150)) | (c("event_id") % 97 == 0)
    return table(spark, d, "events").filter(hard).select("event_id", "user_id", "value", "event_type")


@query(f"WITH {SHOTS} SELECT event_id, strftime(make_timestamp(start_ns // 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(start_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS at, -((-start_ns) // 7) + CASE WHEN (-start_ns) % 7 <> 0 AND -start_ns < 0 THEN 1 ELSE 0 END AS up, (2 * start_ns + 7) // 14 AS nearest, CAST(least(60000, 250 * pow(2, event_id % 12)) AS BIGINT) AS wait_ms FROM f")
def scalar_whole_numbers(spark, d):
    n = F.col("start_ns")
    return shots(spark, d).select("event_id", fn.rfc3339(n).alias("at"), fn.ceil_div(n, 7).alias("up"), fn.half_up(n, 7).alias("nearest"), fn.backoff(F.col("event_id") % 12 + 1, 250, 60000).alias("wait_ms"))


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1) * 100) AS BIGINT)) AS v FROM embeddings) SELECT vec_id, CAST(list_sum(v) * 1000 // len(v) AS BIGINT) AS mean_milli, len(list_filter(v, lambda x: x <= 90)) * 1000000 // len(v) AS black_ppm, len(list_filter(v, lambda x: x >= 115)) * 1000000 // len(v) AS over_ppm FROM p")
def luma_statistics(spark, d):
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100))
    return table(spark, d, "embeddings").select("vec_id", fn.luma(v, 90, 115).alias("l")).select("vec_id", "l.*")


@query("WITH o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT label, vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - p[i]))) / len(e), 6) AS energy FROM o WHERE p IS NOT NULL")
def w6_motion_energy(spark, d):
    """The change of each vector, as a raster, from the one before it of its label."""
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").select("label", "vec_id", F.round(fn.motion_energy(F.col("embedding"), before), 6).alias("energy")).filter("energy is not null")


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","toxic":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'null' END || '}') AS digest, length(lang) || ':' || lang || length(source) || ':' || source AS key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def content_identity(spark, d):
    docs = table(spark, d, "documents").filter("lang is not null and source is not null")
    kinds = {"doc_id": T.LongType(), "lang": T.StringType(), "source": T.StringType(), "toxic": T.BooleanType()}
    digest = fn.content_digest(kinds, source=F.col("source"), doc_id=F.col("doc_id"), toxic=F.when(F.col("doc_id") % 2 == 0, F.lit(True)), lang=F.col("lang"))
    return docs.select("doc_id", digest.alias("digest"), fn.length_prefixed(F.col("lang"), F.col("source")).alias("key"))


@query("SELECT sha256(text) AS digest, CASE WHEN min(doc_id) % 5 = 0 THEN 'MISSING' WHEN min(doc_id) % 7 = 0 THEN 'PARTIAL' WHEN min(doc_id) % 11 = 0 THEN 'CORRUPT' WHEN min(doc_id) % 13 = 0 THEN 'ORPHAN' ELSE 'OK' END AS state FROM documents WHERE text IS NOT NULL GROUP BY 1")
def j9_s18_reconcile(spark, d):
    c = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("i"), (F.min(F.length("text")) + 10).alias("size"))
    orphan = (F.col("i") % 13 == 0) & (F.col("i") % 5 != 0) & (F.col("i") % 7 != 0) & (F.col("i") % 11 != 0)
    have = c.filter("i % 5 <> 0").select("digest", F.when(F.col("i") % 7 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"), F.when(F.col("i") % 11 == 0, F.lit("x")).otherwise(F.col("digest")).alias("actual"))
    return fixtures.reconcile(c.filter(~orphan).select("digest", "size"), have)


@query(f"WITH {SHOTS}, t AS (SELECT *, 'cam/' || camera || '/' || CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'front_left' END AS topic FROM f) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 5 END AS mapped FROM t WHERE recording % 2 = 0")
def s6_s11_topics_of_tenant(spark, d):
    t = shots(spark, d).withColumn("topic", F.concat(F.lit("cam/"), F.col("camera").cast("string"), F.lit("/"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("front_left"))).withColumn("tenant", F.when(F.col("recording") % 2 == 0, "a").otherwise("b"))
    return fixtures.of_tenant(t, "a").select("event_id", fixtures.camera_of(F.col("topic"), {"left": 2, "front_left": 5}).alias("mapped"))
