"""Sources beside tables: fixture documents, topics, stored blobs, tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = "recording_id string, duration_ns long, streams array<struct<topic: string, codec: string, width: int, height: int, fps: double, frames: array<struct<ordinal: long, ts_ns: long>>>>"


def fixture_frames(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, topic, ordinal, ts_ns of fixture documents (one JSON object
    a file).  A document that can't be read whole is an error."""
    docs = spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    s = docs.select("recording_id", "duration_ns", F.explode("streams").alias("s")).select("recording_id", "duration_ns", "s.*")
    return s.select("recording_id", "duration_ns", "topic", "codec", "width", "height", "fps", F.inline("frames"))


def camera_of(topic: Column, cameras: dict[str, int]) -> Column:
    """The camera that a topic maps to, by its longest known ending; an unknown topic is an error."""
    out = None
    for k in sorted(cameras, key=lambda k: (-len(k), k)):
        out = F.when(topic.endswith(k), cameras[k]) if out is None else out.when(topic.endswith(k), cameras[k])
    return out.otherwise(F.raise_error(F.concat(F.lit("no camera for topic "), topic)).cast("int"))


def source_problems(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys and problems (joined codes) of streams whose frames are out of order,
    repeat an ordinal or lie outside [0, duration_ns); others give no row."""
    from pyspark.sql import Window

    before = F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy("ordinal"))
    f = frames.withColumn("_back", F.coalesce(F.col("ts_ns") <= before, F.lit(False)))
    g = f.groupBy(*keys).agg(F.bool_or("_back").alias("back"), (F.countDistinct("ordinal") < F.count("*")).alias("twice"), F.bool_or((F.col("ts_ns") < 0) | (F.col("ts_ns") >= F.col("duration_ns"))).alias("outside"))
    codes = F.array_join(F.array_compact(F.array(F.when(F.col("back"), "NON_MONOTONIC"), F.when(F.col("twice"), "DUPLICATE_ORDINAL"), F.when(F.col("outside"), "OUT_OF_RANGE"))), ",")
    return g.select(*keys, codes.alias("problems")).filter("problems <> ''")


def of_tenant(df: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """The rows of one tenant; rows without one belong to none."""
    return df.filter(F.col(column) == tenant)


def store(blobs: DataFrame, path: str, body: str = "body") -> DataFrame:
    """Writes bodies by their SHA-256, each once, beside what is stored, in
    folders by the digest's first two characters, of which only those of the
    batch are read; returns the digests that were new."""
    spark = blobs.sparkSession
    new = blobs.select(F.sha2(F.col(body), 256).alias("digest"), F.col(body).alias("body")).dropDuplicates(["digest"]).withColumn("prefix", F.substring("digest", 1, 2))
    try:
        there = spark.read.parquet(path).select("prefix", "digest")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    if there is not None:
        new = new.join(there, ["prefix", "digest"], "left_anti")
    from ..checkpoints import settle

    new = settle(new)
    new.write.mode("append").partitionBy("prefix").parquet(path)
    return new.select("digest")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """digest, body and intact of what is stored: whether the body still has its digest."""
    return spark.read.parquet(path).select("digest", "body", (F.sha2("body", 256) == F.col("digest")).alias("intact"))


def reconcile(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """digest and state: MISSING, CORRUPT (another body), PARTIAL (shorter than
    told), ORPHAN (in no manifest) or OK.  manifest: digest, size; stored:
    digest, size, actual."""
    j = manifest.select("digest", F.col("size").alias("_told")).join(stored.select("digest", F.col("size").alias("_have"), "actual"), "digest", "full")
    state = F.when(F.col("_have").isNull(), "MISSING").when(F.col("_told").isNull(), "ORPHAN").when(F.col("_have") < F.col("_told"), "PARTIAL").when(F.col("actual") != F.col("digest"), "CORRUPT").otherwise("OK")
    return j.select("digest", state.alias("state"))


def at_most(df: DataFrame, n: int) -> DataFrame:
    """df, or an error if it has more than n rows; no more than n + 1 are looked at."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"a request may hold {n} rows at most")
    return df
