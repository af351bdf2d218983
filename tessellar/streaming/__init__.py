"""Structured Streaming counterparts of the batch windows and the idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(stream: DataFrame, ts: str, keys: list[str], size: str, hop: str, late: str, aggregates: list[Column]) -> DataFrame:
    """Sliding windows that close once the watermark passes; late rows are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, hop), *keys).agg(*aggregates)


def idempotent_sink(path: str, id_column: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends only ids not yet in the table.  The
    same id with other content stops the stream."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        digest = F.sha2(F.to_json(F.struct(*sorted(batch.columns)), {"ignoreNullFields": "false"}), 256)
        new = batch.withColumn("_digest", digest).dropDuplicates([id_column, "_digest"])
        try:
            there = spark.read.parquet(path).select(F.col(id_column).alias("_id"), F.col("_digest").alias("_old"))
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = None
        twice = new.groupBy(id_column).count().filter("count > 1")
        clash = twice.limit(1).count()
        if there is not None:
            met = new.join(there, F.col(id_column) == F.col("_id"), "left")
            clash += met.filter("_old is not null and _old <> _digest").limit(1).count()
            new = met.filter("_id is null").drop("_id", "_old")
        if clash:
            raise ValueError(f"an {id_column} came with two contents")
        new.write.mode("append").parquet(path)

    return write
