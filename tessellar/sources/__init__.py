"""Tables as the operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAMERAS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as camera frames: camera 1 to 6, recording, nanosecond times and a
    labelled interval from ts for `value` seconds."""
    e = table(spark, sf_dir, "events")
    ts = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) * 1000
    return e.select(
        "event_id", (F.col("user_id") % CAMERAS + 1).cast("int").alias("camera"), F.col("user_id").alias("recording"), F.col("event_type").alias("label"), "value",
        ts.alias("start_ns"), (ts + F.round(F.col("value") * 1e9).cast("long")).alias("end_ns"),
    )
