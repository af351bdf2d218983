"""Recording association and work graphs: pairs, clusters, spread of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle
from . import intervals


def near_pairs(rows: DataFrame, keys: list[str], gap: int, width: int) -> DataFrame:
    """Unordered pairs of a key's intervals (id, start_ns, end_ns) that touch,
    overlap or lie within `gap` of each other: a_..., b_..., gap_ns (0: they
    touch).  Rows meet in time buckets of `width`, not each with all."""
    widened = lambda p: rows.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in keys], (F.col("start_ns") - (gap if p == "a" else 0)).alias(f"{p}_s"), (F.col("end_ns") + (gap + 1 if p == "a" else 1)).alias(f"{p}_e"))
    a, b = widened("a"), widened("b")
    a, b = a.withColumnRenamed("a_start_ns", "a_from").withColumnRenamed("a_end_ns", "a_to"), b.withColumnRenamed("b_start_ns", "b_from").withColumnRenamed("b_end_ns", "b_to")
    a, b = a.withColumnRenamed("a_s", "a_start").withColumnRenamed("a_e", "a_end"), b.withColumnRenamed("b_s", "b_start").withColumnRenamed("b_e", "b_end")
    hit = intervals.overlap_join(a, b, keys, width).filter("a_id < b_id").drop("a_start", "a_end", "b_start", "b_end")
    apart = F.greatest(F.lit(0), F.greatest("a_from", "b_from") - F.least("a_to", "b_to"))
    return hit.withColumn("gap_ns", apart).filter(F.col("gap_ns") <= gap)


def pair_confidence(pairs: DataFrame, evidence: DataFrame, least: int) -> DataFrame:
    """pairs (a_id, b_id, ...) with n_shared and confidence: of each camera that
    both sides' evidence (id, camera, confidence) names with `least` or more,
    the lesser side's greatest confidence; the least of these over cameras."""
    e = evidence.filter(F.col("confidence") >= least).groupBy("id", "camera").agg(F.max("confidence").alias("c"))
    ids = pairs.select("a_id", "b_id")
    j = ids.join(e.select(F.col("id").alias("a_id"), "camera", F.col("c").alias("ca")), "a_id").join(e.select(F.col("id").alias("b_id"), "camera", F.col("c").alias("cb")), ["b_id", "camera"])
    g = j.groupBy("a_id", "b_id").agg(F.min(F.least("ca", "cb")).alias("confidence"), F.count("*").alias("n_shared"))
    return pairs.join(g, ["a_id", "b_id"], "left").fillna(0, ["n_shared"])


def classify(pairs: DataFrame, bridges: DataFrame, gap: int, transitions: bool, least_bridge: int) -> DataFrame:
    """pairs with disposition (MERGED, SPLIT, AMBIGUOUS) and reason.

    pairs: a_id, b_id, a_label, b_label, gap_ns, n_shared, confidence.
    bridges: a_id, b_id, kind, confidence.  Touching pairs of one label merge
    on a shared camera; others need the gap within policy, a shared camera and
    a bridge of the right kind; several strongest bridges are ambiguous."""
    change = F.col("a_label") != F.col("b_label")
    kind = F.when(change, "LABEL_TRANSITION").otherwise("GAP_CONTINUITY")
    need = pairs.select("a_id", "b_id", kind.alias("kind"))
    b = bridges.join(need, ["a_id", "b_id", "kind"]).groupBy("a_id", "b_id").agg(F.max("confidence").alias("_top"), F.expr("count_if(confidence >= %d)" % least_bridge).alias("_able"), F.collect_list("confidence").alias("_all"))
    b = b.withColumn("_ties", F.size(F.filter("_all", lambda x: x == F.col("_top")))).drop("_all")
    j = pairs.join(b, ["a_id", "b_id"], "left").withColumn("_able", F.coalesce("_able", F.lit(0)))
    touching = (F.col("gap_ns") == 0) & ~change
    reason = (
        F.when(touching & (F.col("n_shared") == 0), "INSUFFICIENT_SHARED_CAMERA_SUPPORT")
        .when(touching, "TOUCHING_OR_OVERLAPPING_SHARED_CAMERA")
        .when(F.col("gap_ns") > gap, "GAP_EXCEEDS_POLICY")
        .when(F.col("n_shared") == 0, "INSUFFICIENT_SHARED_CAMERA_SUPPORT")
        .when(change & ~F.lit(transitions), "LABEL_TRANSITIONS_DISABLED")
        .when((F.col("_able") == 0) & change, "LABEL_TRANSITION_REQUIRES_BRIDGE_EVIDENCE")
        .when(F.col("_able") == 0, "GAP_REQUIRES_BRIDGE_EVIDENCE")
        .when(change, "LABEL_TRANSITION_EVIDENCE")
        .otherwise("GAP_CONTINUITY_EVIDENCE")
    )
    j = j.withColumn("reason", reason)
    evidence = F.col("reason").endswith("_EVIDENCE") & ~F.col("reason").contains("REQUIRES")
    disposition = F.when(evidence & (F.col("_ties") > 1), "AMBIGUOUS").when(evidence | (F.col("reason") == "TOUCHING_OR_OVERLAPPING_SHARED_CAMERA"), "MERGED").otherwise("SPLIT")
    edge = F.when(evidence, F.col("_top")).when(disposition == "MERGED", F.col("confidence"))
    return j.withColumn("disposition", disposition).withColumn("edge_confidence", edge).drop("_top", "_able", "_ties")


def ambiguous_sides(edges: DataFrame) -> DataFrame:
    """a_id, b_id of bridged edges (a the earlier side) that tie for the
    strongest on one side of a member."""
    sides = edges.select("a_id", "b_id", "confidence", F.explode(F.array(F.struct(F.col("a_id").alias("member"), F.lit("LATER").alias("side")), F.struct(F.col("b_id").alias("member"), F.lit("EARLIER").alias("side")))).alias("s")).select("a_id", "b_id", "confidence", "s.*")
    w = Window.partitionBy("member", "side")
    top = sides.withColumn("_top", F.max("confidence").over(w)).filter("confidence = _top")
    return top.withColumn("_n", F.count("*").over(w)).filter("_n > 1").select("a_id", "b_id").distinct()


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """id and component (the smallest id that edges a_id, b_id lead to) of each
    node.  Each round takes the least component among neighbours and then that
    component's own; rounds end when none changes, and too many are an error."""
    both = settle(edges.select(F.col("a_id").alias("x"), F.col("b_id").alias("y")).unionByName(edges.select(F.col("b_id").alias("x"), F.col("a_id").alias("y"))).filter("x <> y").distinct())
    now = settle(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        best = both.join(now.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("component").alias("near")).withColumnRenamed("x", "id")
        nxt = now.join(best, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("step"))
        jump = now.select(F.col("id").alias("step"), F.col("component").alias("over"))
        nxt = settle(nxt.join(jump, "step", "left").select("id", "was", F.least("step", "over").alias("component")))
        if not nxt.filter("component <> was").limit(1).count():
            return nxt.select("id", "component")
        now = nxt.select("id", "component")
    raise RuntimeError(f"components haven't settled in {rounds} rounds")


def clusters(members: DataFrame, merged: DataFrame) -> DataFrame:
    """component, ordinal, start_ns, end_ns, labels, n and confidence of
    components of two members or more (component, id, start_ns, end_ns, label);
    confidence: the least of the merged pairs (a_id, confidence) inside."""
    inside = merged.join(members.select(F.col("id").alias("a_id"), "component"), "a_id").groupBy("component").agg(F.min("confidence").alias("confidence"))
    g = members.groupBy("component").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.count("*").alias("n")).filter("n > 1")
    return g.join(inside, "component", "left")


def shared_groups(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """id and component of rows that share a value of any attribute, directly
    or through others: rows and values are the two sides of a graph, each value
    tied to the smallest row that has it, so no value makes all pairs."""
    edges = None
    for a in attributes:
        low = rows.filter(F.col(a).isNotNull()).select(F.col(key).alias("b_id"), F.min(key).over(Window.partitionBy(a)).alias("a_id")).filter("a_id <> b_id")
        edges = low if edges is None else edges.unionByName(low)
    return components(edges, rows.select(F.col(key).alias("id")))


def pair_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn over pairs of clusters' members (id, cluster), precision and
    recall in millionths; a ratio without a denominator is 1,000,000.

    Pairs are counted from sizes of clusters and of their intersections: none is made."""
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    both = found.select("id", F.col("cluster").alias("f")).join(truth.select("id", F.col("cluster").alias("t")), "id")
    sizes = lambda df, *k: F.broadcast(df.groupBy(*k).agg(F.count("*").alias("n")).agg(F.coalesce(pairs, F.lit(0)).alias("n")))
    out = sizes(both, "f", "t").withColumnRenamed("n", "tp").crossJoin(sizes(found, "cluster").withColumnRenamed("n", "p")).crossJoin(sizes(truth, "cluster").withColumnRenamed("n", "t"))  # one row each
    ratio = lambda a, b: F.when(b == 0, F.lit(1_000_000)).otherwise(F.call_function("div", a * 1_000_000, b))
    return out.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"))


def propagate(items: DataFrame, needs: DataFrame, rounds: int = 64) -> DataFrame:
    """id and state after failures have spread: a pending item fails if a
    required upstream has failed, and its children are looked at again; it is
    READY once all its upstreams have ended (failed ones that weren't required
    included).  needs: downstream, upstream, required.  A round a depth."""
    now = settle(items.select("id", "state"))
    need = settle(needs)
    for _ in range(rounds):
        up = need.join(now.select(F.col("id").alias("upstream"), F.col("state").alias("up")), "upstream")
        lost = up.filter("required and up = 'FAILED'").select(F.col("downstream").alias("id")).distinct().withColumn("_lost", F.lit(True))
        nxt = settle(now.join(lost, "id", "left").select("id", F.when(F.col("_lost") & (F.col("state") == "PENDING"), "FAILED").otherwise(F.col("state")).alias("state"), (F.coalesce("_lost", F.lit(False)) & (F.col("state") == "PENDING")).alias("_new")))
        now = nxt.select("id", "state")
        if not nxt.filter("_new").limit(1).count():
            break
    else:
        raise RuntimeError(f"failures are still spreading after {rounds} rounds")
    up = need.join(now.select(F.col("id").alias("upstream"), F.col("state").alias("up")), "upstream")
    waits = up.filter("up in ('PENDING', 'RUNNING')").select(F.col("downstream").alias("id")).distinct().withColumn("_waits", F.lit(True))
    return now.join(waits, "id", "left").select("id", F.when((F.col("state") == "PENDING") & F.col("_waits").isNull(), "READY").otherwise(F.col("state")).alias("state"))


def barrier(members: DataFrame, barriers: DataFrame, key: str) -> DataFrame:
    """overall_status, degraded, failed and is_complete of each barrier.

    members: key, outcome (null or PENDING: open), criticality.  barriers: key,
    expected, empty_semantics, least_success, most_degraded.  A barrier that
    expects none has its empty semantics' status; one whose members haven't all
    ended is PENDING; else SUCCEEDED if no required member failed, enough
    succeeded and not too many degradable ones failed, else INCOMPLETE."""
    good = F.col("outcome").isin("SUCCEEDED", "SKIPPED")
    bad = F.col("outcome").isin("FAILED", "TIMED_OUT", "CANCELLED")
    g = members.groupBy(key).agg(
        F.count_if(good).alias("_good"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("criticality") == "DEGRADABLE")).alias("degraded"),
        F.count_if((F.col("criticality") == "REQUIRED") & ~F.coalesce(good, F.lit(False))).alias("_lost"), F.count_if(good | bad).alias("_ended"),
    )
    j = barriers.join(g, key, "left").fillna(0, ["_good", "failed", "degraded", "_lost", "_ended"])
    empty, done = F.col("expected") == 0, F.col("_ended") >= F.col("expected")
    ok = (F.col("_lost") == 0) & (F.col("_good") >= F.col("least_success")) & (F.col("degraded") <= F.col("most_degraded"))
    status = F.when(empty, F.col("empty_semantics")).when(~done, "PENDING").when(ok, "SUCCEEDED").otherwise("INCOMPLETE")
    zero = lambda c: F.when(empty, F.lit(0)).otherwise(F.col(c)).cast("long")
    return j.select(key, status.alias("overall_status"), zero("degraded").alias("degraded"), zero("failed").alias("failed"), (empty | done).alias("is_complete"))


def ratio_millionths(a: Column, b: Column, none: int) -> Column:
    return F.when(b == 0, F.lit(none)).otherwise(F.call_function("div", a * 1_000_000, b))
