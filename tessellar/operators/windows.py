"""Batch windows over long timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket


def sliding(df: DataFrame, keys: list[str], ts: str, size: int, hop: int, aggregates: list[Column]) -> DataFrame:
    """Windows [k * hop, k * hop + size) from the first one that holds a row to
    the last, empty ones (n_rows 0) too; the last end is clipped to the row after
    the last row's time.  Rows are dealt to the windows that hold them."""
    first, last = bucket(F.col(ts) - size, hop) + 1, bucket(F.col(ts), hop)
    filled = df.withColumn("window_k", F.explode(F.sequence(first, last))).groupBy(*keys, "window_k").agg(F.count("*").alias("n_rows"), *aggregates)
    span = df.groupBy(*keys).agg(F.min(first).alias("_a"), F.max(last).alias("_b"), (F.max(ts) + 1).alias("_stop"))
    every = span.select(*keys, "_stop", F.explode(F.sequence("_a", "_b")).alias("window_k"))
    out = every.join(filled, [*keys, "window_k"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    start = F.col("window_k") * hop
    return out.withColumn("window_start", start).withColumn("window_end", F.least(start + size, F.col("_stop"))).drop("_stop")


def bucket_best(df: DataFrame, keys: list[str], ts: str, width: int, tolerance: int, row: str) -> DataFrame:
    """Of each bucket's rows the one nearest to its middle, within the tolerance."""
    k = bucket(F.col(ts), width)
    off = F.abs(F.col(ts) - (k * width + width // 2))
    near = df.withColumn("bucket", k).withColumn("delta", off).filter(F.col("delta") <= tolerance)
    return near.groupBy(*keys, "bucket").agg(F.min(F.struct("delta", ts, row)).alias("_best")).select(*keys, "bucket", F.col(f"_best.{row}").alias(row), "_best.delta")


def watermark(df: DataFrame, keys: list[str], member: str, order: str, ts: str, lateness: int, members: int) -> DataFrame:
    """df with watermark: the least of all members' (1, 2, ...) latest times so
    far in the key, less the lateness; null until each has a row."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.max(F.when(F.col(member) == m, F.col(ts))).over(so_far) for m in range(1, members + 1)]
    all_known = latest[0].isNotNull()
    for x in latest[1:]:
        all_known = all_known & x.isNotNull()
    return df.withColumn("watermark", F.when(all_known, F.least(*latest) - lateness))


def ring(df: DataFrame, keys: list[str], order: list[str], ts: str, size: str, age: int, budget: int) -> DataFrame:
    """What a buffer holds after the last row of its key: rows no older than
    `age` before the newest, the newest of them whose sizes stay in the budget."""
    newest = F.max(ts).over(Window.partitionBy(*keys))
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_age", newest - F.col(ts)).filter(F.col("_age") <= age).withColumn("_upto", upto).filter(F.col("_upto") <= budget).drop("_age", "_upto")


def closed_prefix(results: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Results that may be reduced: those of ordinals 0, 1, ... up to the first one missing."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return results.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") == F.col(ordinal)).drop("_n")


def late_feedback(feedback: DataFrame, decisions: DataFrame, keys: list[str], at: str, sealed_at: str) -> DataFrame:
    """feedback with effect: APPLIED before the decision was sealed, AUDIT_ONLY
    from then on, PENDING without a decision."""
    j = feedback.join(decisions.select(*keys, F.col(sealed_at).alias("_sealed")), keys, "left")
    return j.withColumn("effect", F.when(F.col("_sealed").isNull(), "PENDING").when(F.col(at) < F.col("_sealed"), "APPLIED").otherwise("AUDIT_ONLY")).drop("_sealed")


def replayed(log: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """log with effect: APPLIED the first time, REPLAY the same again, CONFLICT with other content."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(digest).over(w)
    return log.withColumn("effect", F.when(F.row_number().over(w) == 1, "APPLIED").when(F.col(digest) == first, "REPLAY").otherwise("CONFLICT"))


def hash_chain(df: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """keys, n, root: SHA-256 of each declaration's digest after the one before
    it, in order, from the empty one on.  Sequential in a key: its digests are
    one sorted array."""
    rows = F.array_sort(F.collect_list(F.struct(order, digest)))
    root = F.aggregate(rows, F.sha2(F.lit(""), 256), lambda acc, r: F.sha2(F.concat(acc, r[digest]), 256))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), root.alias("root"))
