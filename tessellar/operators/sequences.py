"""Operators on ordered rows: clocks, cadence, gaps, percentiles, revisions, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clock_epochs(df: DataFrame, keys: list[str], ordinal: str, ts: str) -> DataFrame:
    """df with epoch: a new one where the clock doesn't move on; non_monotonic marks where."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    back = F.coalesce(F.col(ts) <= F.lag(ts).over(w), F.lit(False))
    return df.withColumn("non_monotonic", back).withColumn("epoch", F.sum(F.col("non_monotonic").cast("int")).over(w))


def cadence_gaps(df: DataFrame, keys: list[str], ts: str, least: int, ratio: int) -> DataFrame:
    """Steps longer than max(least, lower median step * ratio), of groups of three rows or more."""
    w = Window.partitionBy(*keys).orderBy(ts)
    steps = df.select(*keys, F.lag(ts).over(w).alias("from_ts"), F.col(ts).alias("to_ts")).filter("from_ts is not null").withColumn("step", F.col("to_ts") - F.col("from_ts"))
    usual = steps.groupBy(*keys).agg(F.expr("percentile_disc(0.5) within group (order by step)").cast("long").alias("usual"), F.count("*").alias("n"))
    return steps.join(usual, keys).filter(F.col("n") >= 2).filter(F.col("step") > F.greatest(F.lit(least), F.col("usual") * ratio)).drop("n")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, int]) -> DataFrame:
    """Four definitions of each share (in percent) by name: nearest rank,
    linear, floor index p (n - 1) / 100 and index n p / 100."""
    held = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"), *[F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"{n}_rank") for n, p in shares.items()], *[F.expr(f"percentile_cont({p / 100}) within group (order by {value})").alias(f"{n}_linear") for n, p in shares.items()])
    size = F.size("_v")
    out = held
    for n, p in shares.items():
        out = out.withColumn(f"{n}_floor", F.element_at("_v", (F.floor((size - 1) * p / 100) + 1).cast("int")))
        out = out.withColumn(f"{n}_index", F.element_at("_v", F.least(size, (F.floor(size * p / 100) + 1).cast("int"))))
    return out.drop("_v")


def current(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each append-only log, and whether its sequence 1..n has no holes."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    all_ = Window.partitionBy(*keys)
    out = df.withColumn("gapless", (F.max(sequence).over(all_) - F.min(sequence).over(all_) + 1) == F.count("*").over(all_)).withColumn("_n", F.row_number().over(w))
    return out.filter("_n = 1").drop("_n")


def rates(df: DataFrame, keys: list[str], ts: str, counter: str) -> DataFrame:
    """Differences of a counter over time between one snapshot and the next."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("d_count", F.col(counter) - F.lag(counter).over(w)).withColumn("d_time", F.col(ts) - F.lag(ts).over(w)).filter("d_time > 0")


def reversals(df: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """How often the direction of a value turns; steps of zero don't count."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    steps = df.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(w))).filter("_d <> 0")
    turned = steps.withColumn("_turn", (F.col("_d") != F.lag("_d").over(w)).cast("int"))
    return turned.groupBy(*keys).agg(F.coalesce(F.sum("_turn"), F.lit(0)).alias("n_reversals"))


def largest_remainder(df: DataFrame, share: str, total: int, tie: str) -> DataFrame:
    """df with seats: floors of share x total, the rest by largest remainder.  A row a group: few rows."""
    quota = F.col(share) * F.lit(float(total))
    out = df.withColumn("_floor", F.floor(quota)).withColumn("_rest", F.round(quota - F.floor(quota), 9))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), tie))
    return out.withColumn("seats", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop("_floor", "_rest")


def holm(df: DataFrame, p: str, tie: str) -> DataFrame:
    """df with adjusted p values: running maximum of p (n - rank + 1), at most 1."""
    w = Window.orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy())
    step = df.withColumn("_x", F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1)))
    return step.withColumn("adjusted", F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_x")


def sampled(fields: list[Column], ratio: float) -> Column:
    """Whether the SHA-256 of the fields, joined by unit separators, falls below the ratio (52 bits of it)."""
    if ratio <= 0 or ratio >= 1:
        return F.lit(ratio >= 1)
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, 13), 16, 10).cast("double") / float(1 << 52) < ratio


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
