"""Cutting the lineage of tables that loops build on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names and read again:
    losing an executor loses nothing.  A local session without that setting
    gets a temporary folder; any other is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="tessellar-")
        context.setCheckpointDir(named)
    return df.checkpoint(True)
