"""Mixing sources to target weights by entropy balancing.

Targets: sources share all words by weight, none above `most` times its own
words; the excess is shared anew by weight (water-filling, in closed form).
Rates: of all document rates that give each source its target, those of least
relative entropy to one copy each are min(most, exp(lambda * size)), with one
multiplier a source: the dual is convex, and Newton steps (kept in a bracket)
solve it for all sources at once, each step an aggregation over the table of
distinct sizes.  Copies: a rate's whole part, and one more where a hash of the
doc_id falls below its fraction; the cuts in those hashes are moved, once the
sums by hash are known, so that a source's words come nearest to its target:
long documents first, then shorter ones to make good what those are off by.

Everything is DataFrame operations; nothing but the rounds' error and counts
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, same_name

#: Weights of the sources by code point, repeating; the most copies.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Newton steps at most; relative error at which they end.
STEPS, ERROR = 60, 1e-9
#: Bins of the hash in which a source's sums are kept for rounding.
BINS = 4096
#: Size classes, halving from each source's mean, that are rounded in turn.
LEVELS = 4


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0.

    White space is made one character, at which the text is split."""
    flat = F.translate(text, "\t\n\x0b\f\r", "     ")
    words = F.size(F.filter(F.split(flat, " "), lambda w: w != ""))
    return F.coalesce(F.when(F.length(text) > 0, words), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table of (source, source_size): one row
    a source, by code point with null last.  min(most * size, weight * level),
    the level such that targets add up to all sizes."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(given, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy()
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all_words", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0))).withColumn("capped_weight", F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    # the level if exactly the sources before this one are at their caps: it rises as long as
    # sources are capped that must be, and falls from there on, so the largest is the right one
    s = s.withColumn("level", (F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, mean, lam: the dual solved for each source.

    hist has (source, size, n) with size > 0; x = size / the source's mean.
    Sources still off by more than ERROR after STEPS are an error."""
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"), F.max("size").alias("largest"))
    s = goals.join(mean, goals["source"].eqNullSafe(mean["source"])).select(goals["source"], "source_size", "target", "mean", "least")
    # at a multiplier beyond the bracket every rate is `most`, or every sum below the target
    up = F.log(F.lit(float(most))) * F.col("mean") / F.col("least")
    down = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    full = F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12)
    s = s.select(
        "source", "source_size", "target", "mean",
        F.when(F.col("target") >= F.col("source_size"), F.lit(0.0)).otherwise(down).alias("lo"),
        F.when(F.col("target") >= F.col("source_size"), up).otherwise(F.lit(0.0)).alias("hi"),
        F.when(full, up + 1).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
    )
    state = cut(s.withColumn("done", full))
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * x)))
        words = F.col("size") * F.col("n")
        free = F.when(rate < most, 1).otherwise(0)
        live = state.filter("not done").select(F.col("source").alias("s"), "mean", "lam")
        sums = hist.join(live, hist["source"].eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(words * rate).alias("got"), F.sum(words * rate * x * free).alias("slope"))
        now = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        ready = F.col("done") | (F.abs(off) <= F.col("target") * ERROR)
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        now = now.select("source", "source_size", "target", "mean", F.when(ready, F.col("lo")).otherwise(lo).alias("lo"), F.when(ready, F.col("hi")).otherwise(hi).alias("hi"), F.when(ready, F.col("lam")).otherwise(step).alias("lam"), ready.alias("done"))
        state = cut(now, drop=state)
        if not state.filter("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"rates haven't settled in {STEPS} steps")
    # sums of doubles differ in their last digits from run to run; the multiplier is told to nine
    return cut(state.select("source", "source_size", "target", "mean", F.round("lam", 9).alias("lam")), drop=state)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (copies x size).

    No document has more than `most` copies.  A document without words (null
    or empty text) has size 0 and one copy; a source without words, target 0.
    A null source is a source.  Rows that share a doc_id and size get the same
    number of copies, at every run.  Columns pass through, but those of the
    added names are replaced; an empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in docs.columns if not same_name(c, added)]
    # the rows' own columns travel in a struct, so that no name of theirs meets one of these
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(1).alias("row"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.lit(20240229)).alias("h"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
    )
    small = cut(rows.select("h", "source", "size"))
    hist = cut(small.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut(targets(sizes, weights, most))
    solved = multipliers(hist.filter("size > 0"), goals.filter("source_size > 0"), most)

    rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean"))))
    fraction = F.col("rate") - F.floor("rate")
    # where in its fraction the hash falls: below 1, one copy more; sums by bins of this say where the cut must be
    place = F.least(F.lit(BINS - 1), F.floor(F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) / F.greatest(fraction, F.lit(1e-12)) * F.lit(BINS / 4.0))).cast("int")
    # 0: above the source's mean size; each next one, half as long
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.col("mean") / F.col("size"))))).cast("int")
    named = small.filter("size > 0").join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    named = named.withColumn("whole", F.floor("rate")).withColumn("bin", F.when(F.col("rate") >= most, F.lit(BINS)).otherwise(place)).withColumn("level", level)
    # a row for each source, level and bin; then one for each source
    size = F.col("size").cast("double")
    sums = named.groupBy("s", "level", "bin").agg(F.sum(F.col("whole") * size).alias("base"), F.sum(F.when(F.col("bin") < BINS, size).otherwise(0.0)).alias("more"), F.sum(F.col("rate") * size).alias("due"))
    upto = F.sum("more").over(Window.partitionBy("s", "level").orderBy("bin"))
    by_level = sums.withColumn("upto", upto).groupBy("s", "level").agg((F.sum("base") - F.sum("due")).alias("bare"), F.array_sort(F.collect_list(F.when(F.col("bin") < BINS - 1, F.struct("bin", "upto")))).alias("bins"))
    levels = by_level.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("level", "bare", "bins"))).alias("levels"))

    def choose(done: Column, this: Column) -> Column:
        """Long documents first: what their rounding is off by, the shorter ones make good.
        Bins up to the cut get one copy more; -1: none does."""
        bare = done["off"] + this["bare"]
        tried = F.transform(this["bins"], lambda b: F.struct(F.abs(bare + b["upto"]).alias("far"), b["bin"].alias("bin"), (bare + b["upto"]).alias("off")))
        best = F.array_min(F.concat(F.array(F.struct(F.abs(bare).alias("far"), F.lit(-1).alias("bin"), bare.alias("off"))), tried))
        return F.struct(best["off"].alias("off"), F.map_concat(done["cuts"], F.create_map(this["level"], best["bin"])).alias("cuts"))

    chosen = F.aggregate("levels", F.struct(F.lit(0.0).alias("off"), F.expr("cast(map() as map<int, int>)").alias("cuts")), choose, lambda done: done["cuts"])
    plan = goals.withColumnRenamed("source", "p").join(solved.select(F.col("source").alias("s1"), "mean", "lam"), F.col("p").eqNullSafe(F.col("s1")), "left").join(levels.select("s", chosen.alias("cuts")), F.col("p").eqNullSafe(F.col("s")), "left")
    plan = cut(plan.select("p", "source_size", "target", "mean", "lam", "cuts"))  # a row a source: the planner sees its size
    for done in (small, hist, goals, solved):
        release(done)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p")), "left").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    copies = F.when(F.col("size") == 0, F.lit(1)).when(F.col("rate") >= most, F.lit(most)).otherwise(F.floor("rate") + F.when(place <= F.coalesce(F.element_at("cuts", level), F.lit(-1)), 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)
