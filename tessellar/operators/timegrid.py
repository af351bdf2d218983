"""Exact rational time on long columns; products in decimal(38, 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def floor_div(n: Column, d: int) -> Column:
    """Exact floor(n / d) of whole numbers, d > 0."""
    d_ = F.lit(d).cast("decimal(38,0)")
    return ((_wide(n) - F.pmod(_wide(n), d_)) / d_).cast("decimal(38,0)")


def round_half_even(n: Column, d: int) -> Column:
    """n / d rounded to the nearest whole number, ties to the even one."""
    q, r2 = floor_div(n, d), F.pmod(_wide(n), F.lit(d).cast("decimal(38,0)")) * 2
    odd = F.pmod(q, F.lit(2).cast("decimal(38,0)")) == 1
    return (q + F.when((r2 > d) | ((r2 == d) & odd), 1).otherwise(0)).cast("long")


def affine(source: Column, num: int, den: int, from_: int, to: int) -> Column:
    """to + (source - from_) * num / den, rounded half to even."""
    return F.lit(to) + round_half_even((_wide(source) - from_) * num, den)


def grid_targets(spans: DataFrame, keys: list[str], start: str, end: str, period_num: int, period_den: int, origin: int = 0) -> DataFrame:
    """Every k with start <= origin + round(k * num / den) < end, one row each."""
    # the first candidates lie one step around the exact quotient; rounding decides
    low = floor_div((_wide(F.col(start)) - origin) * period_den, period_num) - 1
    high = floor_div((_wide(F.col(end)) - origin) * period_den, period_num) + 1
    rows = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("k"))
    rows = rows.withColumn("target_ns", F.lit(origin) + round_half_even(_wide(F.col("k")) * period_num, period_den))
    return rows.filter("target_ns >= _s and target_ns < _e").drop("_s", "_e")


def nearest(targets: DataFrame, frames: DataFrame, keys: list[str], tolerance: int, usable: str | None = None) -> DataFrame:
    """Each target's nearest frame within the tolerance: frame_id, frame_ns,
    status SELECTED, DECODE_FAILED (only unusable ones there) or NO_FRAME.

    Ties go to the earlier frame, then the smaller id.  Frames and targets meet
    in time buckets as wide as the tolerance: an equality join, merged, since
    either side may be large."""
    width = max(1, tolerance)
    t = targets.withColumn("_b", F.explode(F.array(*[bucket(F.col("target_ns"), width) + i for i in (-1, 0, 1)])))
    f = frames.withColumn("_b", bucket(F.col("frame_ns"), width))
    ok = F.col(usable) if usable else F.lit(True)
    delta = F.abs(F.col("frame_ns") - F.col("target_ns"))
    hits = t.hint("merge").join(f, [*keys, "_b"]).filter(delta <= tolerance)
    best = hits.groupBy(*keys, "k").agg(F.min(F.struct((~ok).alias("bad"), delta.alias("delta"), "frame_ns", "frame_id")).alias("best"))
    out = targets.hint("merge").join(best, [*keys, "k"], "left")
    status = F.when(F.col("best").isNull(), "NO_FRAME").when(F.col("best.bad"), "DECODE_FAILED").otherwise("SELECTED")
    return out.select(*keys, "k", "target_ns", F.col("best.frame_id").alias("frame_id"), F.col("best.frame_ns").alias("frame_ns"), F.col("best.delta").alias("delta"), status.alias("status"))


def one_use(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Of targets that selected one frame the nearest keeps it (then the
    earliest); the others become DEDUPLICATED_FRAME."""
    w = Window.partitionBy(*keys, "status", "frame_id").orderBy("delta", "target_ns", "k")
    taken = (F.col("status") == "SELECTED") & (F.row_number().over(w) > 1)
    return selected.withColumn("status", F.when(taken, "DEDUPLICATED_FRAME").otherwise(F.col("status")))


def segment_lookup(rows: DataFrame, segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with the segment whose [seg_start, seg_end) holds `order`; null if none.

    As-of by one sorted pass: segments and rows are put in order together and
    each row takes the last segment begun, so no row meets all segments."""
    a = segments.select(*keys, F.col("seg_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("seg_id", "seg_start", "seg_end").alias("_seg"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"))
    b = rows.select(*keys, F.col(order).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_seg"].dataType).alias("_seg"), F.struct(*rows.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_seg", True).over(w)).filter("_kind = 1")
    return out.select("_row.*", F.when(F.col("_at") < F.col("_last.seg_end"), F.col("_last.seg_id")).alias("seg_id"))
