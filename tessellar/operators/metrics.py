"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibration(df: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """n, brier and ece: bins of [k / bins, (k + 1) / bins), 1 in the last."""
    b = df.withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)))
    per = b.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(probability).alias("p"), F.avg(truth).alias("t"), F.sum(F.pow(F.col(probability) - F.col(truth), 2)).alias("sq"))
    n = F.sum("n")
    return per.agg(n.alias("n"), (F.sum("sq") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("t"))) / n).alias("ece"))


def precision_recall(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    p, t = F.col(predicted) == 1, F.col(truth) == 1
    of = df.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return of.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def histogram_drift(df: DataFrame, cohort: str, a: str, b: str, value: str) -> DataFrame:
    """Total variation between two cohorts' shares of a value."""
    share = df.filter(F.col(cohort).isin(a, b)).groupBy(cohort, value).count()
    share = share.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(cohort)))
    both = share.groupBy(value).agg(F.sum(F.when(F.col(cohort) == a, F.col("share")).otherwise(0.0)).alias("pa"), F.sum(F.when(F.col(cohort) == b, F.col("share")).otherwise(0.0)).alias("pb"))
    return both.agg((F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2).alias("total_variation"))
