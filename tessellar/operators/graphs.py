"""Work graphs: readiness; the Pareto front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ready(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending items none of whose upstreams is unfinished."""
    waiting = needs.join(items.select(F.col("id").alias("upstream"), F.col("state").alias("up_state")), "upstream").filter("up_state <> 'SUCCEEDED'").select(F.col("downstream").alias("id"))
    return items.filter("state = 'PENDING'").join(waiting, "id", "left_anti")


def pareto(df: DataFrame, key: str, gain: str, cost: str) -> DataFrame:
    """Rows that no other beats: as much gain at as little cost, better in one.

    One ordered pass instead of a self-join: by cost, a row stays if its gain is
    above the best of all cheaper rows and no less than the best at its cost."""
    from pyspark.sql import Window

    best = df.groupBy(cost).agg(F.max(gain).alias("_best"))
    cheaper = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("_before", F.max("_best").over(cheaper)).filter("_before is null or _best > _before")
    return df.join(kept.select(cost, "_best"), cost).filter(F.col(gain) == F.col("_best")).drop("_best")
