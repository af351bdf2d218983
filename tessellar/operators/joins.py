"""Joins with rules: exact pairings, reference checks, skew, differences of nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timegrid


def camera_skew(targets: DataFrame, frames: DataFrame, keys: list[str], cameras: int, tolerance: int) -> DataFrame:
    """keys, k, target_ns, n_cameras and skew_ns of each target: the spread of
    the cameras' nearest times; null unless all have one within the tolerance."""
    x = frames.withColumn("frame_id", F.col("frame_ns"))
    t = targets.withColumn("camera", F.explode(F.sequence(F.lit(1), F.lit(cameras))))
    near = timegrid.nearest(t, x, [*keys, "camera"], tolerance)
    g = near.groupBy(*keys, "k", "target_ns").agg(F.count("frame_ns").alias("n_cameras"), (F.max("frame_ns") - F.min("frame_ns")).alias("_skew"))
    return g.withColumn("skew_ns", F.when(F.col("n_cameras") == cameras, F.col("_skew"))).drop("_skew")


def pair_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, ordinal, a, b: the i-th row of one beside the i-th of the other, as far as both go."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a = left.select(*keys, n.alias("ordinal"), F.col(value).alias("a"))
    b = right.select(*keys, n.alias("ordinal"), F.col(value).alias("b"))
    return a.join(b, [*keys, "ordinal"])


def exact_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its one counterpart; a key that one side lacks, or has twice, is an error."""
    one = lambda df, p: df.groupBy(*keys).agg(F.count("*").alias(f"_{p}n"), F.first(F.struct(*[c for c in df.columns if c not in keys])).alias(f"_{p}"))
    j = one(left, "a").join(one(right, "b"), keys, "full")
    ok = F.when((F.col("_an") == 1) & (F.col("_bn") == 1), F.lit(True)).otherwise(F.raise_error(F.lit("both sides must have each key exactly once")).cast("boolean"))
    return j.filter(ok).select(*keys, "_a.*", "_b.*")


def unknown_references(references: DataFrame, catalogue: DataFrame, token: str) -> DataFrame:
    """References whose token the catalogue lacks; with any, an output is rejected."""
    return references.join(catalogue.select(token).distinct(), token, "left_anti")


def rejected_outputs(references: DataFrame, catalogue: DataFrame, token: str, output: str) -> DataFrame:
    return unknown_references(references, catalogue, token).select(output).distinct()


def upstream_states(needs: DataFrame, items: DataFrame) -> DataFrame:
    """downstream, n, all_done and any_failed of each item's upstreams."""
    j = needs.join(items.select(F.col("id").alias("upstream"), F.col("state").alias("_s")), "upstream")
    return j.groupBy("downstream").agg(F.count("*").alias("n"), F.bool_and(F.col("_s") == "SUCCEEDED").alias("all_done"), F.bool_or(F.col("_s") == "FAILED").alias("any_failed"))


def flatten(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, leaf of the members of a JSON object's text; deeper values are
    leaves as they stand.  A text that is no object has none."""
    m = F.from_json(F.col(value), "map<string, string>")
    return df.select(key, F.explode(m).alias("path", "leaf"))


def map_diff(left: DataFrame, right: DataFrame, key: str, path: str, value: str, tolerances: dict[str, float], ignored: list[str]) -> DataFrame:
    """key, path, kind of paths that differ: ADDED, REMOVED, CHANGED.  Numbers
    within the tolerance of the longest prefix of the path are equal; paths
    under an ignored prefix are left out."""
    j = left.select(key, path, F.col(value).alias("_a")).join(right.select(key, path, F.col(value).alias("_b")), [key, path], "full")
    for p in ignored:
        j = j.filter(~F.col(path).startswith(p))
    allowed = F.lit(0.0)
    for p in sorted(tolerances, key=len):  # longer prefixes last: they win
        allowed = F.when(F.col(path).startswith(p), F.lit(float(tolerances[p]))).otherwise(allowed)
    a, b = F.expr("try_cast(_a as double)"), F.expr("try_cast(_b as double)")
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(a - b) <= allowed, F.lit(False))
    kind = F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), "ADDED").when(F.col("_b").isNull() & F.col("_a").isNotNull(), "REMOVED").when(~same, "CHANGED")
    return j.select(key, path, kind.alias("kind")).filter("kind is not null")


def mismatch_reasons(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields that differ, in the order given."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in fields.items()]))


def isotonic(score: Column, knots: list[tuple[float, float]]) -> Column:
    """The score on a rising line through the knots, flat beyond the ends."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(score <= x1, y0 + (score - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(score <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)
