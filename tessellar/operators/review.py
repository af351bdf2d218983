"""Review, admission, planning and control: budgets, ledgers, targets, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket

#: Signals of admission control with the delay (ms) each suggests.
DELAYS = {"QUEUE_DEPTH": 1000, "OLDEST_AGE": 500, "WORKER_UTILIZATION": 500, "BACKLOG_SLOPE": 2000, "PROVIDER_QUOTA": 1000, "ARRIVAL_EXCEEDS_SERVICE": 1500}


def select_within(df: DataFrame, order: list[Column], budget: int, eligible: Column, missing: Column, inapplicable: Column) -> DataFrame:
    """df with decision: NOT_ELIGIBLE, MISSING_TERM, NOT_APPLICABLE, or SELECTED
    for the first `budget` of the others in order, BUDGET_EXHAUSTED for the
    rest.  Only rows that the budget's last one might be are sorted."""
    why = F.when(~eligible, "NOT_ELIGIBLE").when(missing, "MISSING_TERM").when(inapplicable, "NOT_APPLICABLE")
    rows = df.withColumn("_why", why)
    first = rows.filter("_why is null").orderBy(*order).limit(budget).select(*df.columns).withColumn("decision", F.lit("SELECTED"))
    rest = rows.join(first.select(*df.columns).distinct(), df.columns, "left_anti").withColumn("decision", F.coalesce("_why", F.lit("BUDGET_EXHAUSTED"))).drop("_why")
    return first.unionByName(rest)


def open_queue(tasks: DataFrame, now: Column) -> DataFrame:
    """Open tasks and whether they are overdue, urgent ones first."""
    return tasks.filter("state = 'OPEN'").withColumn("overdue", F.col("due") < now).orderBy("priority", F.asc_nulls_last("due"), "requested", "id")


def latest(log: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the greatest sequence of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def admission(sources: DataFrame, alignments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """id, admitted and reason of each source (id, state): the first that fails
    of: the source is READY, its alignment (id, in_cohort) is there and in the
    cohort, its outcome (id, outcome) is there and ADMISSIBLE."""
    j = sources.join(alignments.select("id", "in_cohort"), "id", "left").join(outcomes.select("id", "outcome"), "id", "left")
    why = (
        F.when(F.col("state") != "READY", "SOURCE_NOT_READY").when(F.col("in_cohort").isNull(), "NO_ALIGNMENT").when(~F.col("in_cohort"), "OUTSIDE_COHORT")
        .when(F.col("outcome").isNull(), "NO_OUTCOME").when(F.col("outcome") != "ADMISSIBLE", "NOT_ADMISSIBLE").otherwise("ADMITTED")
    )
    return j.select("id", (why == "ADMITTED").alias("admitted"), why.alias("reason"))


def reconcile_counts(cohorts: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """key, expected, counted and whether the outcomes add up to the cohort."""
    n = outcomes.groupBy(key).agg(F.count("*").alias("counted"))
    return cohorts.join(n, key, "left").fillna(0, ["counted"]).withColumn("whole", F.col("expected") == F.col("counted"))


def chain_breaks(log: DataFrame, keys: list[str], sequence: str, digest: str, parent: str, tie: str) -> DataFrame:
    """Rows whose sequence isn't one more than the one before's, or whose
    parent isn't its digest; the first of a chain is 0 and has no parent."""
    w = Window.partitionBy(*keys).orderBy(sequence, tie)
    out = log.withColumn("_s", F.lag(sequence).over(w)).withColumn("_d", F.lag(digest).over(w))
    ok = F.when(F.col("_s").isNull(), (F.col(sequence) == 0) & F.col(parent).isNull()).otherwise((F.col(sequence) == F.col("_s") + 1) & F.col(parent).eqNullSafe(F.col("_d")))
    return out.filter(~ok).drop("_s", "_d")


def sealed(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, contiguous (ordinals 0..n-1, each once), covered (each has
    exactly one result with its digest) and closed (both)."""
    r = results.groupBy(*keys, "ordinal").agg(F.count("*").alias("_n"), F.min("digest").alias("_got"))
    j = plan.join(r, [*keys, "ordinal"], "full")
    g = j.groupBy(*keys).agg(
        F.count("digest").alias("n"), F.min("ordinal").alias("_a"), F.max("ordinal").alias("_z"), F.countDistinct("ordinal").alias("_u"), F.count("*").alias("_all"),
        F.bool_and(F.coalesce((F.col("_n") == 1) & (F.col("_got") == F.col("digest")), F.lit(False))).alias("covered"),
    )
    g = g.withColumn("contiguous", (F.col("_a") == 0) & (F.col("_z") == F.col("n") - 1) & (F.col("_u") == F.col("n")) & (F.col("_all") == F.col("n")))
    return g.select(*keys, "n", "contiguous", "covered", (F.col("contiguous") & F.col("covered")).alias("closed"))


def neighbour_targets(triggers: DataFrame, keys: list[str], offsets: list[int], start: Column, end: Column, per_camera: int, total: int) -> DataFrame:
    """keys, camera, target_ns, n_triggers and kept of the targets around
    triggers (ts): offsets of each, inside [start, end), each target of a camera
    once; kept: the earliest `per_camera` of a camera, then `total` of a key."""
    t = triggers.withColumn("target_ns", F.explode(F.transform(F.array(*[F.lit(o).cast("long") for o in offsets]), lambda o: F.col("ts") + o)))
    t = t.filter((F.col("target_ns") >= start) & (F.col("target_ns") < end)).groupBy(*keys, "camera", "target_ns").agg(F.count("*").alias("n_triggers"))
    own = F.row_number().over(Window.partitionBy(*keys, "camera").orderBy("target_ns"))
    t = t.withColumn("_own", own)
    # the second rank is among those within the first budget only
    w = Window.partitionBy(*keys, F.col("_own") <= per_camera).orderBy("target_ns", "camera")
    return t.withColumn("kept", (F.col("_own") <= per_camera) & (F.row_number().over(w) <= total)).drop("_own")


def frame_bound(duration_ns: Column, num: int, den: int) -> Column:
    """ceil(duration * num / (1e9 * den)), exact."""
    a, b = duration_ns.cast("decimal(38,0)") * num, F.lit(1_000_000_000 * den).cast("decimal(38,0)")
    rest = F.pmod(a, b)
    return ((a - rest) / b).cast("long") + F.when(rest > 0, 1).otherwise(0)


def split_interval(df: DataFrame, start: str, end: str, span: int, overlap: int) -> DataFrame:
    """Parts of at most `span`, each `overlap` into the one before, the last one
    short: df with part, part_start, part_end, n_parts."""
    stride = span - overlap
    if stride <= 0:
        raise ValueError("the overlap must be shorter than the span")
    length = F.col(end) - F.col(start)
    n = F.when(length <= span, F.lit(1).cast("long")).otherwise(bucket(length - overlap + stride - 1, stride))
    out = df.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    return out.withColumn("part_start", F.col(start) + F.col("part") * stride).withColumn("part_end", F.least(F.col(end), F.col("part_start") + span))


def union_targets(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of both, each once, with the reasons of all (arrays joined in order)."""
    both = base.select(*keys, "reason", F.lit(0).alias("_b")).unionByName(more.select(*keys, "reason", F.lit(1).alias("_b")))
    return both.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), (F.min("_b") == 0).alias("in_base"))


def first_triggers(triggers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first trigger of each key, by order."""
    return triggers.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def admit(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metrics with pressure (THROTTLED, ELEVATED, NORMAL), signals, admitted
    and delay_ms.  limits: depth, age, utilization, slope."""
    c = F.col
    named = {
        "QUEUE_DEPTH": c("depth") > limits["depth"], "OLDEST_AGE": c("oldest_age_ms") > limits["age"], "WORKER_UTILIZATION": c("utilization") >= limits["utilization"],
        "BACKLOG_SLOPE": c("slope") > limits["slope"], "PROVIDER_QUOTA": c("quota") == 0, "ARRIVAL_EXCEEDS_SERVICE": (c("arrival") > c("service")) & (c("slope") > 0),
    }
    signals = F.array_compact(F.array(*[F.when(v, k) for k, v in named.items()]))
    delay = F.greatest(*[F.when(v, F.lit(DELAYS[k])).otherwise(F.lit(0)) for k, v in named.items()])
    near = F.coalesce((c("depth") * 4 >= 3 * limits["depth"]) | (c("oldest_age_ms") * 4 >= 3 * limits["age"]) | F.coalesce(c("slope") * 4 >= 3 * limits["slope"], F.lit(False)), F.lit(False))
    out = metrics.withColumn("signals", signals).withColumn("delay_ms", delay)
    pressure = F.when(F.size("signals") > 0, "THROTTLED").when(near, "ELEVATED").otherwise("NORMAL")
    return out.withColumn("pressure", pressure).withColumn("admitted", F.size("signals") == 0)


def aimd(decisions: DataFrame, keys: list[str], start: int, least: int, most: int, add: int, factor: float, cooldown_ms: int) -> DataFrame:
    """keys, at_ms, limit_after, admitted of a controller's decisions (at_ms,
    admitted, depth) in time order: a throttled one multiplies the limit, an
    admitted one adds to it once the cooldown has passed; an admitted depth
    beyond the new limit is throttled.  The fold is sequential in a key: a
    controller's observations of one window, sorted, in one array."""
    rows = F.array_sort(F.collect_list(F.struct("at_ms", "admitted", "depth")))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        free = last["at_ms"].isNull() | (r["at_ms"] >= last["at_ms"] + cooldown_ms)
        down = F.greatest(F.lit(least).cast("long"), F.floor(last["limit_after"] * factor))
        up = F.least(F.lit(most).cast("long"), last["limit_after"] + add)
        limit = F.when(~r["admitted"], down).when(free, up).otherwise(last["limit_after"])
        return F.concat(acc, F.array(F.struct(r["at_ms"].alias("at_ms"), limit.cast("long").alias("limit_after"), (r["admitted"] & (r["depth"] <= limit)).alias("admitted"))))

    first = F.array(F.struct(F.lit(None).cast("long").alias("at_ms"), F.lit(start).cast("long").alias("limit_after"), F.lit(None).cast("boolean").alias("admitted")))
    folded = decisions.groupBy(*keys).agg(F.aggregate(rows, first, step).alias("_f"))
    return folded.select(*keys, F.inline(F.slice("_f", 2, F.greatest(F.lit(1), F.size("_f") - 1)))).filter("at_ms is not null")


def fair_load(stages: DataFrame, weight: str, busy: str, queued: str) -> DataFrame:
    """Stages with work queued, least weighted load first: who is served next."""
    return stages.filter(F.col(queued) > 0).withColumn("load", F.col(busy) / F.col(weight)).orderBy("load", "stage")


def due(leases: DataFrame, now: Column, base_ms: int, cap_ms: int, attempts: int) -> DataFrame:
    """leases with next: EXPIRED ones (RETRY at retry_at, or DEAD after so many
    attempts), HELD ones, and FREE ones; the wait doubles up to a cap."""
    wait = F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("long")
    lost = F.col("expires_ms").isNotNull() & (F.col("expires_ms") <= now)
    state = F.when(F.col("expires_ms").isNull(), "FREE").when(~lost, "HELD").when(F.col("attempt") >= attempts, "DEAD").otherwise("RETRY")
    return leases.withColumn("next", state).withColumn("retry_at", F.when(state == "RETRY", F.col("expires_ms") + wait))
