"""Half-open [start, end) interval algebra on long columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, order: list[str] = ()) -> DataFrame:
    """df with island, numbering runs of intervals that start no later than gap
    after the furthest end before them; an interval that touches joins."""
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + F.lit(gap)), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w)).drop("_opens")


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """One row an island: keys, island, start, end, and the number of intervals merged."""
    return islands(df, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))


def merge_runs(df: DataFrame, keys: list[str], label: str, start: str, end: str, gap: int = 0, order: list[str] = ()) -> DataFrame:
    """Merges an interval only with the group right before it, if that has its
    label: another label in between splits."""
    w = Window.partitionBy(*keys).orderBy(start, end, label, *order)
    before = F.lag(label).over(w)
    df = df.withColumn("_new", F.when(before.isNull() | (before != F.col(label)), 1).otherwise(0)).withColumn("run", F.sum("_new").over(w)).drop("_new")
    return merge(df, [*keys, "run", label], start, end, gap)


def pad_clip(df: DataFrame, start: str, end: str, pad: int, low: Column, high: Column) -> DataFrame:
    """Widened by pad on both sides, cut to [low, high); truncated says which were cut. Empty results go."""
    a, b = F.col(start) - pad, F.col(end) + pad
    out = df.withColumn("_a", F.greatest(a, low)).withColumn("_b", F.least(b, high)).withColumn("truncated", (a < low) | (b > high))
    return out.withColumn(start, F.col("_a")).withColumn(end, F.col("_b")).drop("_a", "_b").filter(F.col(start) < F.col(end))


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return merge(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("pieces"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) that intersect.

    Both sides are dealt into time buckets of `width`; a pair is kept in the
    first bucket that both touch, so none comes twice and no row meets all
    others."""

    def bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = bucket(F.col(s), width), bucket(F.col(e) - 1, width)
        return df.withColumn("_bucket", F.explode(F.sequence(first, last)))

    a, b = bucketed(left, "a_start", "a_end"), bucketed(right, "b_start", "b_end")
    hit = a.join(b, [*keys, "_bucket"]).filter("a_start < b_end and b_start < a_end")
    return hit.filter(F.col("_bucket") == bucket(F.greatest("a_start", "b_start"), width)).drop("_bucket")


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column, empty: float = 0.0) -> Column:
    """Intersection over the hull: 0 when disjoint; `empty` when the hull has no
    length, both being empty at one time."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull == 0, F.lit(empty)).otherwise(F.try_divide(both, hull))
