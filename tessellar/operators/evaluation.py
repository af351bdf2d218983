"""Evaluation: event and boundary metrics, intervals of confidence, tests, gates, capacity."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_edges(edges: DataFrame, group: str) -> DataFrame:
    """One-to-one matches of a group's edges (a_id, b_id, iou): best iou first,
    then smaller ids.  An edge is taken once it is the best of both its ends
    among those left; rounds of that give the sequential choice without one
    task holding a group."""
    from ..checkpoints import settle

    left = settle(edges.select(group, "a_id", "b_id", "iou"))
    taken = None
    best = F.struct(-F.col("iou"), F.col("a_id"), F.col("b_id"))
    while left.limit(1).count():
        a, b = F.min(best).over(Window.partitionBy(group, "a_id")), F.min(best).over(Window.partitionBy(group, "b_id"))
        won = settle(left.withColumn("_a", a).withColumn("_b", b).filter((F.col("_a") == best) & (F.col("_b") == best)).select(group, "a_id", "b_id", "iou"))
        taken = won if taken is None else taken.unionByName(won)
        left = settle(left.join(won.select(group, "a_id"), [group, "a_id"], "left_anti").join(won.select(group, "b_id"), [group, "b_id"], "left_anti"))
    return taken if taken is not None else left


def event_metrics(matches: DataFrame, found: DataFrame, truth: DataFrame, key: str, hours: Column) -> DataFrame:
    """key, recall, miss, false_per_hour, duplicates, n_truth of each class:
    found and truth have key and id, matches key, a_id (found) and b_id (truth).
    duplicates: found that touch a truth another took (edges beyond the match)."""
    t = truth.groupBy(key).agg(F.count("*").alias("n_truth"))
    f = found.groupBy(key).agg(F.count("*").alias("n_found"), hours.alias("hours"))
    m = matches.groupBy(key).agg(F.count("*").alias("hits"))
    j = t.join(f, key, "full").join(m, key, "left").fillna(0, ["n_truth", "n_found", "hits"])
    return j.select(key, "n_truth", "n_found", "hits", F.coalesce(F.try_divide("hits", "n_truth"), F.lit(0.0)).alias("recall"), (F.col("n_truth") - F.col("hits")).alias("missed"), F.coalesce(F.try_divide(F.col("n_found") - F.col("hits"), F.col("hours")), F.lit(0.0)).alias("false_per_hour"))


def boundary_metrics(pairs: DataFrame, tolerance: int, empty: float = 0.0) -> DataFrame:
    """One row: start_mae, end_mae, median_error, p95_error (index n * 0.95),
    mean iou, within_tolerance and accuracy of pairs (a_start, a_end, b_start,
    b_end, same).  empty: the iou of two empty intervals at one time."""
    from .intervals import iou

    e = pairs.select(F.abs(F.col("a_start") - F.col("b_start")).alias("s"), F.abs(F.col("a_end") - F.col("b_end")).alias("e"), iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"), empty).alias("iou"), F.col("same").cast("int").alias("same"))
    one = e.agg(F.avg("s").alias("start_mae"), F.avg("e").alias("end_mae"), F.avg("iou").alias("iou"), F.avg("same").alias("accuracy"), F.count("*").alias("n"))
    errors = e.select(F.explode(F.array("s", "e")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    # errors by value with running counts: no list of all of them is made
    ranked = upto(errors, "x", "k").withColumn("_n", F.sum("k").over(Window.partitionBy()))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("x")))
    n = F.col("_n")
    of = ranked.agg(
        ((at(F.expr("(_n - 1) div 2")) + at(F.expr("_n div 2"))) / 2).alias("median_error"), at(F.least(n - 1, F.floor(n * 0.95))).alias("p95_error"),
        (F.sum(F.when(F.col("x") <= tolerance, F.col("k")).otherwise(0)) / F.max("_n")).alias("within_tolerance"),
    )
    return one.crossJoin(F.broadcast(of))  # one row each


def upto(counts: DataFrame, value: str, n: str, parts: int = 64) -> DataFrame:
    """counts (distinct values, n of each) with upto: how many are at or below
    the value.  Sums inside ranges of values, then those of the ranges before:
    no window holds the whole table."""
    split = counts.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id())
    from ..checkpoints import settle

    split = settle(split)
    before = split.groupBy("_p").agg(F.sum(n).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")  # a row a part
    inside = F.sum(n).over(Window.partitionBy("_p").orderBy(value))
    return split.withColumn("_in", inside).join(F.broadcast(before), "_p").withColumn("upto", F.col("_in") + F.col("_before")).drop("_in", "_before", "_p")


def recall_at(found: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """query, relevant, hits and recall: the share of a query's relevant items among its first k."""
    hits = found.filter(F.col(rank) <= k).select(query, item).distinct().join(relevant, [query, item], "left_semi").groupBy(query).agg(F.count("*").alias("hits"))
    out = relevant.groupBy(query).agg(F.count("*").alias("relevant")).join(hits, query, "left").fillna(0, ["hits"])
    return out.withColumn("recall", F.col("hits") / F.col("relevant"))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """b_only, c_only, statistic (with continuity) and exact two-sided p_value of
    paired right/wrong columns.  The tail is summed as logarithms of binomials,
    over the distinct counts up to the lesser one."""
    t = rows.agg(F.count_if(F.col(a) & ~F.col(b)).alias("b_only"), F.count_if(~F.col(a) & F.col(b)).alias("c_only"))
    n, low = F.col("b_only") + F.col("c_only"), F.least("b_only", "c_only")
    # ln of C(n, k) / 2^n by its recurrence, carried along the sequence of k
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), low),
        F.struct((-n * math.log(2)).alias("ln"), F.lit(0.0).alias("sum")),
        lambda acc, k: F.struct(F.when(k < n, acc["ln"] + F.log((n - k) / (k + 1))).otherwise(acc["ln"]).alias("ln"), (acc["sum"] + F.exp(acc["ln"])).alias("sum")),
        lambda acc: F.least(F.lit(1.0), 2 * acc["sum"]),
    )
    stat = F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(F.col("b_only") - F.col("c_only")) - 1, F.lit(2)) / n)
    return t.select("b_only", "c_only", stat.alias("statistic"), F.when(n == 0, F.lit(1.0)).otherwise(tail).alias("p_value"))


def bootstrap(clusters: DataFrame, total: str, n: str, resamples: int, seed: int, share: float = 0.95) -> DataFrame:
    """One row: mean, lower, upper of a clustered bootstrap.  Clusters (a row
    each: the sum and number of their values) are drawn with replacement: each
    resample weighs each cluster by a Poisson count from a hash of both, so
    resamples are sums by key, in one pass, the same at every run.  The bounds
    are percentiles (linear) of the resamples' means."""
    u = lambda k: (F.pmod(F.xxhash64(F.col("_key"), F.col("r"), F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = clusters.select(F.xxhash64(*clusters.columns).alias("_key"), F.col(total).alias("_t"), F.col(n).alias("_n"))
    cdf, p = [], math.exp(-1)
    acc = 0.0
    for k in range(12):
        acc += p
        p /= k + 1
        cdf.append(acc)
    drawn = u(0)
    weight = sum((F.when(drawn > c, 1).otherwise(0) for c in cdf), F.lit(0))
    sums = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("_t")) / F.sum(F.col("w") * F.col("_n"))).alias("m"))
    tail = (1 - share) / 2
    bounds = sums.agg(F.expr(f"percentile_cont({tail}) within group (order by m)").alias("lower"), F.expr(f"percentile_cont({1 - tail}) within group (order by m)").alias("upper"))
    return rows.agg((F.sum("_t") / F.sum("_n")).alias("mean")).crossJoin(F.broadcast(bounds))  # one row each


def bootstrap_exact(values: list[float], resamples: int, seed: int, share: float = 0.95) -> tuple[float, float, float]:
    """The same of a short list in the order given, drawn by CPython's generator."""
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(resamples))
    cut = lambda p: pd.Series(means).quantile(p)
    return sum(values) / len(values), float(cut((1 - share) / 2)), float(cut(1 - (1 - share) / 2))


def gates(required: DataFrame, metrics: DataFrame) -> DataFrame:
    """category, passed and why of each gate (category, name, least, most): a
    category without its metric, or a value beyond its bounds, rejects."""
    j = required.join(metrics.select("category", "name", "value"), ["category", "name"], "left")
    why = F.when(F.col("value").isNull(), "MISSING").when(F.col("value") < F.col("least"), "TOO_LOW").when(F.col("value") > F.col("most"), "TOO_HIGH").otherwise("OK")
    return j.select("category", "name", (why == "OK").alias("passed"), why.alias("why"))


def capacity(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, per_hour, busy_share, realtime_factor of samples (units, busy_ns,
    wall_ns, media_ns); null where a denominator is 0."""
    g = samples.groupBy(*keys).agg(F.sum("units").alias("u"), F.sum("busy_ns").alias("b"), F.sum("wall_ns").alias("w"), F.sum("media_ns").alias("m"))
    return g.select(*keys, F.try_divide(F.col("u") * 3.6e12, F.col("w")).alias("per_hour"), F.try_divide("b", "w").alias("busy_share"), F.try_divide("b", "m").alias("realtime_factor"))


def selectivity(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of scanned, structured and vector hits, and their ratio; 0 without a denominator."""
    g = profile.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("scanned", "structured", "vector")])
    return g.withColumn("ratio", F.coalesce(F.try_divide("vector", "structured"), F.lit(0.0)))


def subgroup_metrics(rows: DataFrame, group: str) -> DataFrame:
    """group, coverage, yield and agreement in whole millionths (0 without a
    denominator), and bias: the group's yield less that of all."""
    parts = [F.count("*").alias("n"), F.count_if("selected").alias("s"), F.count_if(F.col("selected") & F.col("useful")).alias("u"), F.count_if(F.col("selected") & F.col("agreed")).alias("a")]
    ratio = lambda x, y: F.when(F.col(y) == 0, F.lit(0)).otherwise(F.call_function("div", F.col(x) * 1_000_000, F.col(y)))
    g, all_ = rows.groupBy(group).agg(*parts), rows.agg(*parts).select(ratio("u", "s").alias("_all"))
    g = g.crossJoin(F.broadcast(all_))  # one row
    return g.select(group, ratio("s", "n").alias("coverage"), ratio("u", "s").alias("yield"), ratio("a", "s").alias("agreement"), (ratio("u", "s") - F.col("_all")).alias("bias"))


def device_summary(samples: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Least, mean and greatest of each value."""
    return samples.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.min, "min"), (F.avg, "mean"), (F.max, "max"))])


def backlog(snapshots: DataFrame, keys: list[str], ts: str, depth: str) -> DataFrame:
    """peak, last, and net slope (last less first over the time between)."""
    g = snapshots.groupBy(*keys).agg(F.max(depth).alias("peak"), F.max_by(depth, ts).alias("last"), F.min_by(depth, ts).alias("_first"), (F.max(ts) - F.min(ts)).alias("_t"))
    return g.select(*keys, "peak", "last", F.try_divide(F.col("last") - F.col("_first"), F.col("_t")).alias("slope"))
