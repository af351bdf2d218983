"""Where queries and their SQL are kept by name, and views that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S = 1_000_000_000

#: Events as frames of six cameras: recording user_id div 6, camera by event_id.
SHOTS = "f AS (SELECT event_id, CAST(event_id % 6 + 1 AS INTEGER) AS camera, user_id // 6 AS recording, event_type AS label, value, epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(round(value * 1e9) AS BIGINT) AS end_ns FROM events)"


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.withColumn("camera", (F.col("event_id") % 6 + 1).cast("int")).withColumn("recording", F.expr("recording div 6"))
