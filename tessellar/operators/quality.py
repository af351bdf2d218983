"""Quality assessment: camera statuses, issues, recordings and their completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

#: Statuses by severity, cameras, codecs that can be decoded.
SEVERITY = ("GOOD", "DEGRADED", "UNUSABLE", "UNKNOWN")
CAMERAS = 6
CODECS = ("h264", "h265", "hevc", "vp8", "vp9", "av1")
#: Least bytes of a container.
LEAST_BYTES = 1024


def total_map(value: Column, names: dict[str, str]) -> Column:
    """The value's name; a value that has none is an error."""
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("no status for "), F.coalesce(value.cast("string"), F.lit("null")))))


def rank(status: Column) -> Column:
    """GOOD 0, DEGRADED 1, UNUSABLE 2, UNKNOWN 3; null for others."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.when(place > 0, (place - 1).cast("int"))


def worst(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The severest status of each group."""
    return df.groupBy(*keys).agg(F.max(F.struct(rank(F.col(status)).alias("rank"), F.col(status).alias("status"))).alias("_w")).select(*keys, "_w.status")


def stream_issues(width: Column, height: Column, fps: Column, duration: Column, codec: Column) -> Column:
    """Codes of what is wrong with a stream's metadata, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when((width <= 0) | (height <= 0), "INVALID_RESOLUTION"),
            F.when(fps <= 0, "INVALID_FPS"),
            F.when(duration <= 0, "INVALID_DURATION"),
            F.when(~F.lower(codec).isin(*CODECS), "UNSUPPORTED_CODEC"),
        )
    )


def stream_status(issues: Column) -> Column:
    """PASS without issues; FAIL for metadata that can't be; DEGRADED for a codec only."""
    bad = F.arrays_overlap(issues, F.array(*[F.lit(x) for x in ("INVALID_RESOLUTION", "INVALID_FPS", "INVALID_DURATION")]))
    return F.when(F.size(issues) == 0, "PASS").when(bad, "FAIL").otherwise("DEGRADED")


def container_status(size: Column, least: int = LEAST_BYTES) -> Column:
    """PASS, or what is wrong with a file of this many bytes (null: there is none)."""
    return F.when(size.isNull(), "NOT_FOUND").when(size == 0, "EMPTY").when(size < least, "TOO_SMALL").otherwise("PASS")


def reduce_intervals(df: DataFrame, keys: list[str], start: str, end: str, source: str, gap: int, pad: int, low: Column, high: Column) -> DataFrame:
    """Intervals of all sources of a key merged while one starts no later than
    gap after the furthest end before it; padded, cut to [low, high); with the
    distinct sources, in order.  low, high: of the key's columns.  An empty
    result is an error."""
    i = intervals.islands(df, keys, start, end, gap)
    out = i.groupBy(*keys, "island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.count("*").alias("n_merged"), F.array_sort(F.collect_set(source)).alias("sources"), F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    out = out.withColumn(start, F.greatest(F.col("_s") - pad, F.col("_lo"))).withColumn(end, F.least(F.col("_e") + pad, F.col("_hi")))
    ok = F.when(F.col(start) < F.col(end), F.col(end)).otherwise(F.raise_error(F.lit("padding and clipping left an empty interval")).cast("long"))
    return out.withColumn(end, ok).drop("_s", "_e", "_lo", "_hi")


def six_slots(df: DataFrame, keys: list[str], status: str, missing: str = "INCOMPLETE") -> DataFrame:
    """One row for each key and camera; cameras without a row get `missing`."""
    every = df.select(*keys).distinct().withColumn("camera", F.explode(F.sequence(F.lit(1), F.lit(CAMERAS))))
    return every.join(df.select(*keys, "camera", status), [*keys, "camera"], "left").withColumn(status, F.coalesce(status, F.lit(missing)))


def recording_status(coarse: DataFrame, dense: DataFrame | None, keys: list[str], least_usable: int, quality: dict[str, float], blocking: bool = True) -> DataFrame:
    """overall_status, usable and overall_quality of six cameras' statuses;
    dense statuses, where a key has them, take the place of coarse ones."""
    rows = coarse.select(*keys, "camera", "status")
    if dense is not None:
        rows = rows.join(dense.select(*keys, "camera", F.col("status").alias("_dense")), [*keys, "camera"], "left").withColumn("status", F.coalesce("_dense", "status")).drop("_dense")
    n = F.count_if(F.col("status").isin("GOOD", "DEGRADED"))
    score = total_map(F.col("status"), {k: str(v) for k, v in quality.items()}).cast("double")
    of = rows.groupBy(*keys).agg(n.alias("usable"), F.count_if(F.col("status") == "INCOMPLETE").alias("_open"), F.count("*").alias("_n"), F.round(F.avg(score), 4).alias("overall_quality"))
    status = F.when(F.col("_n") != CAMERAS, F.raise_error(F.lit("a recording has six cameras"))).when((F.col("_open") > 0) & F.lit(blocking), "INCOMPLETE").when(F.col("usable") == CAMERAS, "USABLE").when(F.col("usable") >= least_usable, "DEGRADED").otherwise("UNUSABLE")
    return of.select(*keys, status.alias("overall_status"), "usable", "overall_quality")


def coarse_status(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """INCOMPLETE with an UNKNOWN, else REQUIRES_DENSE with a DEGRADED or UNUSABLE, else COMPLETE."""
    s = F.col(status)
    return df.groupBy(*keys).agg(F.when(F.bool_or(s == "UNKNOWN"), "INCOMPLETE").when(F.bool_or(s.isin("DEGRADED", "UNUSABLE")), "REQUIRES_DENSE").otherwise("COMPLETE").alias("coarse_status"))


def completion(coarse: Column, dense: Column, failure: Column) -> Column:
    """The final status of a recording's assessment, given its coarse status,
    that of its dense stage (null: not run) and the dense stage's failure."""
    both = F.raise_error(F.lit("a dense result and a dense failure exclude each other"))
    none = F.raise_error(F.lit("all-good coarse evidence has no dense stage"))
    return (
        F.when(coarse == "INCOMPLETE", "QA_INCOMPLETE")
        .when((coarse == "REQUIRES_DENSE") & dense.isNotNull() & failure.isNotNull(), both)
        .when((coarse == "REQUIRES_DENSE") & failure.isNotNull(), "QA_INCOMPLETE")
        .when((coarse == "REQUIRES_DENSE") & dense.isNull(), "DENSE_REQUIRED")
        .when(coarse == "REQUIRES_DENSE", F.when(dense == "COMPLETE", "QA_COMPLETE").otherwise("QA_INCOMPLETE"))
        .when(dense.isNotNull() | failure.isNotNull(), none)
        .otherwise("QA_COMPLETE")
    )


def disposition(*found: Column) -> Column:
    """UNAVAILABLE before UNUSABLE before DEGRADED before UNKNOWN before USABLE."""
    out = None
    for name in ("UNAVAILABLE", "UNUSABLE", "DEGRADED", "UNKNOWN"):
        any_ = found[0] == name
        for f in found[1:]:
            any_ = any_ | (f == name)
        out = F.when(any_, name) if out is None else out.when(any_, name)
    return out.otherwise("USABLE")


def issue_codes(media: Column, semantic: Column) -> Column:
    """Codes of both, the semantic ones marked, each once, in order."""
    return F.array_sort(F.array_union(media, F.transform(semantic, lambda x: F.concat(F.lit("semantic:"), x))))


def class_cascade(observed: DataFrame, verdicts: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """The state of every class for every key of verdicts.

    observed: keys, class.  verdicts: keys, incomplete and abstained (arrays of
    classes), incomplete_reasons and abstained_reasons (arrays of codes).  A
    class is OBSERVED if it was, else INCOMPLETE_INPUT if named so (or if no
    class is named but a reason is), else ABSTAINED by the same rule, else
    NO_ISSUE."""
    every = verdicts.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    seen = observed.select(*keys, "class").distinct().withColumn("_seen", F.lit(True))
    j = every.join(seen, [*keys, "class"], "left")
    named = lambda c: F.array_contains(c, F.col("class")) | ((F.size(c) == 0) & (F.size(f"{c}_reasons") > 0))
    state = F.when(F.col("_seen"), "OBSERVED").when(named("incomplete"), "INCOMPLETE_INPUT").when(named("abstained"), "ABSTAINED").otherwise("NO_ISSUE")
    return j.select(*keys, "class", state.alias("state"))


def cascade_status(states: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("state")
    return states.groupBy(*keys).agg(F.when(F.bool_or(s == "INCOMPLETE_INPUT"), "INCOMPLETE_INPUT").when(F.bool_or(s == "ABSTAINED"), "ABSTAINED").otherwise("COMPLETE").alias("status"), F.count_if(s == "OBSERVED").alias("n_observed"))


def non_monotonic(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Rows whose time is not after the one before, with the interval between
    the two; equal times have none (null)."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    out = df.withColumn("_before", before).filter(F.col(ts) <= F.col("_before"))
    moved = F.col(ts) < F.col("_before")
    return out.withColumn("back_from", F.when(moved, F.col(ts))).withColumn("back_to", F.when(moved, F.col("_before"))).drop("_before")


def flagged_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, ts: str, least: int) -> DataFrame:
    """Runs of rows that are flagged one after another, from the first to the
    last one's time, that last `least` or longer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    f = df.withColumn("_on", flag)
    f = f.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w)).filter("_on")
    runs = f.groupBy(*keys, "_run").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("n_rows"))
    return runs.filter(F.col("run_end") - F.col("run_start") >= least).drop("_run")


def accepted(df: DataFrame, keys: list[str], arrival: str, ts: str) -> DataFrame:
    """df with accepted: whether the time is after all that came before it; a
    rejected row holds up none that comes later."""
    before = F.max(ts).over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("accepted", before.isNull() | (F.col(ts) > before))
