"""Evaluation metrics over the test tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources import table
from .registry import SHOTS, query, shots

# an order's line is a found event, the same order's next line the truth it may match
_BOUNDS = "p AS (SELECT a.event_id, a.start_ns AS a_start, a.end_ns AS a_end, a.start_ns + CAST(a.event_id % 7 * 1000000000 AS BIGINT) AS b_start, a.end_ns + CAST(a.event_id % 5 * 500000000 AS BIGINT) AS b_end, a.event_id % 9 <> 0 AS same FROM f a)"


@query(f"""WITH {SHOTS}, {_BOUNDS}, e AS (SELECT abs(a_start - b_start) AS x FROM p UNION ALL SELECT abs(a_end - b_end) FROM p), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM e)
SELECT round((SELECT avg(abs(a_start - b_start)) FROM p), 3) AS start_mae, round((SELECT avg(abs(a_end - b_end)) FROM p), 3) AS end_mae, round((SELECT avg(greatest(0, least(a_end, b_end) - greatest(a_start, b_start)) / (greatest(a_end, b_end) - least(a_start, b_start))) FROM p), 6) AS iou, round((SELECT avg(CAST(same AS INTEGER)) FROM p), 6) AS accuracy,
(SELECT count(*) FROM p) AS n, (SELECT median(x) FROM e) AS median_error, (SELECT x FROM o WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95_error, round((SELECT avg(CASE WHEN x <= 2000000000 THEN 1.0 ELSE 0 END) FROM e), 6) AS within_tolerance""")
def a25_boundary_metrics(spark, d):
    p = shots(spark, d).select(F.col("start_ns").alias("a_start"), F.col("end_ns").alias("a_end"), (F.col("start_ns") + F.col("event_id") % 7 * 1_000_000_000).alias("b_start"), (F.col("end_ns") + F.col("event_id") % 5 * 500_000_000).alias("b_end"), (F.col("event_id") % 9 != 0).alias("same"))
    # the SQL divides 0 by 0 for two empty intervals at one time, which is NaN
    m = evaluation.boundary_metrics(p, 2_000_000_000, empty=float("nan"))
    return m.select(*[F.round(c, 3).alias(c) for c in ("start_mae", "end_mae")], *[F.round(c, 6).alias(c) for c in ("iou", "accuracy", "within_tolerance")], "n", "median_error", "p95_error")


@query("""WITH t AS (SELECT p_brand AS k, count(*) AS n_truth FROM part WHERE p_size > 20 GROUP BY 1), f AS (SELECT p_brand AS k, count(*) AS n_found, sum(p_retailprice) / 1000 AS hours FROM part WHERE p_size > 25 OR p_partkey % 10 = 0 GROUP BY 1), m AS (SELECT p_brand AS k, count(*) AS hits FROM part WHERE p_size > 25 GROUP BY 1)
SELECT coalesce(t.k, f.k) AS p_brand, coalesce(n_truth, 0) AS n_truth, coalesce(n_found, 0) AS n_found, coalesce(hits, 0) AS hits, round(coalesce(hits / n_truth, 0), 6) AS recall, coalesce(n_truth, 0) - coalesce(hits, 0) AS missed, round(coalesce((n_found - coalesce(hits, 0)) / hours, 0), 6) AS false_per_hour FROM t FULL JOIN f ON t.k = f.k LEFT JOIN m ON m.k = coalesce(t.k, f.k)""")
def a24_event_metrics(spark, d):
    p = table(spark, d, "part")
    out = evaluation.event_metrics(p.filter("p_size > 25"), p.filter("p_size > 25 or p_partkey % 10 = 0"), p.filter("p_size > 20"), "p_brand", F.sum("p_retailprice") / 1000)
    return out.withColumn("recall", F.round("recall", 6)).withColumn("false_per_hour", F.round("false_per_hour", 6))


@query("""WITH r AS (SELECT l_orderkey AS q, l_suppkey AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS i FROM lineitem WHERE l_returnflag <> 'N'), h AS (SELECT q, count(*) AS hits FROM (SELECT DISTINCT r.q, r.i FROM r JOIN t ON r.q = t.q AND r.i = t.i WHERE k <= 3) GROUP BY q)
SELECT t.q, count(*) AS relevant, coalesce(any_value(hits), 0) AS hits, round(coalesce(any_value(hits), 0) / count(*), 6) AS recall FROM t LEFT JOIN h ON t.q = h.q GROUP BY t.q""")
def a28_recall_at(spark, d):
    lines = table(spark, d, "lineitem")
    found = lines.select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("i"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("k"))
    truth = lines.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("i")).distinct()
    return evaluation.recall_at(found, truth, "q", "i", "k", 3).withColumn("recall", F.round("recall", 6))


@query("""WITH c AS (SELECT count(*) FILTER (n_chars > 800 AND quality = 0) AS b, count(*) FILTER (n_chars <= 800 AND quality = 1) AS c FROM documents JOIN labels USING (doc_id)), s AS (SELECT b, c, b + c AS n, least(b, c) AS low FROM c),
k AS (SELECT b, c, n, unnest(generate_series(0, low)) AS k FROM s) SELECT any_value(b) AS b_only, any_value(c) AS c_only, round(any_value((abs(b - c) - 1) * (abs(b - c) - 1) / n), 6) AS statistic, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p_value FROM k""")
def a32_mcnemar(spark, d):
    j = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 800).alias("a")).join(table(spark, d, "labels"), "doc_id").select("a", (F.col("quality") == 1).alias("b"))
    return evaluation.mcnemar(j, "a", "b").withColumn("statistic", F.round("statistic", 6)).withColumn("p_value", F.round("p_value", 6))


@query(None)
def a31_bootstrap(spark, d):
    """The mean line price, clustered by order, with its 95 % interval of 200 resamples."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("t"), F.count("*").alias("n"))
    return evaluation.bootstrap(g, "t", "n", 200, 17)


@query(None)
def j18_greedy_iou_match(spark, d):
    from . import catalog
    from ..sources import frames

    pairs = catalog.a30_interval_iou(spark, d).join(frames(spark, d).select(F.col("event_id").alias("a_id"), "label"), "a_id")
    return evaluation.greedy_edges(pairs, "label")


@query("""WITH m AS (SELECT l_shipdate::DATE AS x, 'c' || (l_suppkey % 10) AS category, l_returnflag AS name, avg(l_quantity) AS value FROM lineitem WHERE l_suppkey % 10 <> 4 GROUP BY ALL), v AS (SELECT category, name, max(value) AS value FROM m GROUP BY ALL), g AS (SELECT 'c' || unnest(range(10)) AS category), r AS (SELECT category, name FROM g, (SELECT unnest(['A', 'N', 'R']) AS name))
SELECT r.category, r.name, coalesce(value >= 40 AND value <= 49.5, false) AS passed, CASE WHEN value IS NULL THEN 'MISSING' WHEN value < 40 THEN 'TOO_LOW' WHEN value > 49.5 THEN 'TOO_HIGH' ELSE 'OK' END AS why FROM r LEFT JOIN v ON r.category = v.category AND r.name = v.name""")
def x30_promotion_gates(spark, d):
    lines = table(spark, d, "lineitem").filter("l_suppkey % 10 <> 4").withColumn("category", F.concat(F.lit("c"), (F.col("l_suppkey") % 10).cast("string")))
    v = lines.groupBy(F.to_date("l_shipdate").alias("x"), "category", F.col("l_returnflag").alias("name")).agg(F.avg("l_quantity").alias("v")).groupBy("category", "name").agg(F.max("v").alias("value"))
    r = spark.range(10).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("name"), F.lit(40.0).alias("least"), F.lit(49.5).alias("most"))
    return evaluation.gates(r, v)


@query("SELECT l_suppkey, round(count(*) * 3.6e12 / sum(CAST(1000000000 AS BIGINT) * (l_linenumber + 1)), 6) AS per_hour, round(sum(1000000 * l_quantity) / sum(CAST(1000000000 AS BIGINT) * (l_linenumber + 1)), 6) AS busy_share, round(sum(1000000 * l_quantity) / nullif(sum(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 2000000 END), 0), 6) AS realtime_factor FROM lineitem GROUP BY 1")
def a38_capacity(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.lit(1).alias("units"), (F.col("l_quantity") * 1_000_000).alias("busy_ns"), (1_000_000_000 * (F.col("l_linenumber").cast("long") + 1)).alias("wall_ns"), F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(2_000_000).alias("media_ns"))
    return evaluation.capacity(lines, ["l_suppkey"]).select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("per_hour", "busy_share", "realtime_factor")])


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS scanned, CAST(sum(CASE WHEN lang = 'en' THEN 0 ELSE n_chars // 2 END) AS BIGINT) AS structured, CAST(sum(n_chars // 3) AS BIGINT) AS vector, round(coalesce(sum(n_chars // 3) / nullif(sum(CASE WHEN lang = 'en' THEN 0 ELSE n_chars // 2 END), 0), 0), 6) AS ratio FROM documents GROUP BY lang")
def x31_selectivity(spark, d):
    p = table(spark, d, "documents").select("lang", F.col("n_chars").alias("scanned"), F.when(F.col("lang") == "en", 0).otherwise(F.expr("n_chars div 2")).alias("structured"), F.expr("n_chars div 3").alias("vector"))
    return evaluation.selectivity(p, ["lang"]).withColumn("ratio", F.round("ratio", 6))


@query("""WITH r AS (SELECT lang, n_chars > 700 AS s, quality = 1 AS u, doc_id % 3 <> 0 AS a FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL), x AS (SELECT count(*) FILTER (s AND u) * 1000000 // nullif(count(*) FILTER (s), 0) AS all_y FROM r)
SELECT lang, count(*) FILTER (s) * 1000000 // count(*) AS coverage, coalesce(count(*) FILTER (s AND u) * 1000000 // nullif(count(*) FILTER (s), 0), 0) AS yield, coalesce(count(*) FILTER (s AND a) * 1000000 // nullif(count(*) FILTER (s), 0), 0) AS agreement, coalesce(count(*) FILTER (s AND u) * 1000000 // nullif(count(*) FILTER (s), 0), 0) - any_value(all_y) AS bias FROM r, x GROUP BY lang""")
def x19_learning_metrics(spark, d):
    j = table(spark, d, "documents").filter("lang is not null").join(table(spark, d, "labels"), "doc_id")
    rows = j.select("lang", (F.col("n_chars") > 700).alias("selected"), (F.col("quality") == 1).alias("useful"), (F.col("doc_id") % 3 != 0).alias("agreed"))
    return evaluation.subgroup_metrics(rows, "lang")


@query("SELECT s_nationkey, min(s_acctbal) AS s_acctbal_min, round(avg(s_acctbal), 6) AS s_acctbal_mean, max(s_acctbal) AS s_acctbal_max FROM supplier GROUP BY 1")
def a37_device_summary(spark, d):
    return evaluation.device_summary(table(spark, d, "supplier"), ["s_nationkey"], ["s_acctbal"]).withColumn("s_acctbal_mean", F.round("s_acctbal_mean", 6))


@query(f"WITH {SHOTS} SELECT recording, max(CAST(floor(value) AS BIGINT)) AS peak, arg_max(CAST(floor(value) AS BIGINT), start_ns) AS last, round((arg_max(CAST(floor(value) AS BIGINT), start_ns) - arg_min(CAST(floor(value) AS BIGINT), start_ns)) / (max(start_ns) - min(start_ns)) * 1e12, 6) AS slope FROM f GROUP BY recording")
def a39_backlog(spark, d):
    f = shots(spark, d).withColumn("depth", F.floor("value"))
    return evaluation.backlog(f, ["recording"], "start_ns", "depth").withColumn("slope", F.round(F.col("slope") * 1e12, 6))
