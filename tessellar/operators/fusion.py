"""Multi-view evidence: outcomes, boundaries, scores, adjudication."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors of camera statuses and of their quality.
STATUS_FACTOR = {"SUPPORTING": 1.0, "PARTIAL": 0.5}
QUALITY_FACTOR = {"GOOD": 1.0, "DEGRADED": 0.7}
CAMERAS = 6


def _factor(value: Column, factors: dict[str, float]) -> Column:
    out = None
    for k, v in factors.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(0.0)


def _codes(*named: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for c, name in named]))


def view_scores(evidence: DataFrame, keys: list[str], weights: dict[str, float], least_supporting: int, least_confidence: float) -> DataFrame:
    """keys, confidence, supporting and ambiguity of candidates' camera evidence.

    evidence: keys, status, quality, and a column for each other weight
    (null: 0).  A camera's share is its status factor times the weighted mean
    of its features; the six shares are summed and divided by six."""
    total = sum(weights.values())
    of = {**{w: F.coalesce(F.col(w), F.lit(0.0)) for w in weights if w != "qa"}, "qa": _factor(F.col("quality"), QUALITY_FACTOR)}
    share = sum((F.lit(weights[w]) * of[w] for w in weights), F.lit(0.0)) / total * _factor(F.col("status"), STATUS_FACTOR)
    g = evidence.groupBy(*keys).agg(F.sum(share).alias("_sum"), F.count_if(F.col("status").isin(*STATUS_FACTOR)).alias("supporting"))
    g = g.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_sum") / CAMERAS)))
    codes = _codes((F.col("supporting") < least_supporting, "INSUFFICIENT_CAMERA_SUPPORT"), (F.col("confidence") < least_confidence, "LOW_UNCALIBRATED_CONFIDENCE"))
    return g.select(*keys, "confidence", "supporting", F.when(F.size(codes) > 0, F.array_join(codes, "+")).otherwise("RESOLVED").alias("ambiguity"))


def camera_outcome(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """SUPPORTED with any positive row, NO_ACTION if there are rows and all say
    NO_EVENT, else INDETERMINATE."""
    s = F.col(status)
    return rows.groupBy(*keys).agg(F.when(F.bool_or(s == "POSITIVE"), "SUPPORTED").when(F.bool_and(s == "NO_EVENT"), "NO_ACTION").otherwise("INDETERMINATE").alias("outcome"))


def candidate_outcome(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """SUPPORTED with any such camera, NO_ACTION if all six say so, else INDETERMINATE."""
    o = F.col("outcome")
    return cameras.groupBy(*keys).agg(F.when(F.bool_or(o == "SUPPORTED"), "SUPPORTED").when(F.count_if(o == "NO_ACTION") == CAMERAS, "NO_ACTION").otherwise("INDETERMINATE").alias("outcome"))


def camera_boundaries(rows: DataFrame, keys: list[str], start: str, end: str, error: str, low: Column, high: Column) -> DataFrame:
    """keys (camera among them), estimate and uncertainty: the envelope of the
    observed intervals, widened by the alignment error, cut to [low, high)."""
    g = rows.groupBy(*keys).agg(F.min(F.greatest(F.col(start) - F.col(error), low)).alias("a"), F.max(F.least(F.col(end) + F.col(error), high)).alias("z"))
    g = g.filter("a < z")
    return g.select(*keys, "a", "z", F.expr("a + (z - a) div 2").alias("estimate"), F.expr("(z - a + 1) div 2").alias("uncertainty"))


def role_boundary(cameras: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, estimate, uncertainty and n of roles seen by `least` cameras: the
    lower median of their estimates, and how far the farthest reaches from it."""
    # percentile_disc answers in doubles, too narrow for nanoseconds; a role has at most six cameras
    m = cameras.groupBy(*keys).agg(F.expr("element_at(sort_array(collect_list(estimate)), cast((count(*) + 1) div 2 as int))").alias("_m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    j = cameras.join(m, keys)
    return j.groupBy(*keys, "n").agg(F.first("_m").alias("estimate"), F.max(F.abs(F.col("estimate") - F.col("_m")) + F.col("uncertainty")).alias("uncertainty"))


def action_boundary(roles: DataFrame, keys: list[str], role: str) -> DataFrame:
    """keys, onset, offset, status: REFINED if the onset is before the offset,
    CONFLICT if not, MISSING without both; overlap tells that the two
    uncertainties meet."""
    pick = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    g = roles.groupBy(*keys).agg(pick("ONSET", "estimate").alias("onset"), pick("OFFSET", "estimate").alias("offset"), pick("ONSET", "uncertainty").alias("_u"), pick("OFFSET", "uncertainty").alias("_v"))
    status = F.when(F.col("onset").isNull() | F.col("offset").isNull(), "MISSING").when(F.col("onset") < F.col("offset"), "REFINED").otherwise("CONFLICT")
    return g.select(*keys, "onset", "offset", status.alias("status"), (F.col("onset") + F.col("_u") >= F.col("offset") - F.col("_v")).alias("overlap"))


def with_fallback(actions: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """The refined interval, or the proposal's own where there is none."""
    j = proposals.join(actions, keys, "left")
    ok = F.coalesce(F.col("status") == "REFINED", F.lit(False))
    return j.select(*keys, F.when(ok, F.col("onset")).otherwise(F.col("start_ns")).alias("start_ns"), F.when(ok, F.col("offset")).otherwise(F.col("end_ns")).alias("end_ns"), (~ok).alias("used_fallback"))


def narrows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a boundary without the doubtful cameras is strictly surer: both
    must be there."""
    j = before.select(*keys, F.col("uncertainty").alias("before")).join(after.select(*keys, F.col("uncertainty").alias("after")), keys, "left")
    return j.withColumn("narrows", F.coalesce(F.col("after") < F.col("before"), F.lit(False)))


def perception_fusion(facts: DataFrame, keys: list[str], support: dict[str, float], quality: dict[str, float], default_visibility: float, least_observable: int, least_supporting: int, least_confidence: float) -> DataFrame:
    """keys, confidence, camera counts, ambiguity and refine of cameras' facts.

    facts: keys, camera, relation, visibility, disposition.  A camera's
    reliability and support are means over its facts that aren't NOT_OBSERVABLE
    (reliability: visibility times the factor of its quality); confidence is
    the support weighed by reliability over the observable cameras."""
    seen = F.col("relation") != "NOT_OBSERVABLE"
    reliability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("visibility"), F.lit(default_visibility)) * _factor(F.col("disposition"), quality)))
    per = facts.groupBy(*keys, "camera").agg(
        F.avg(F.when(seen, reliability)).alias("rel"), F.avg(F.when(seen, _factor(F.col("relation"), support))).alias("sup"), F.bool_or(seen).alias("observable"),
        F.bool_or(F.col("relation") == "SUPPORTS").alias("supporting"), F.bool_or(F.col("relation") == "CONTRADICTS").alias("contradicting"), F.bool_or(F.col("disposition").isin("UNUSABLE", "UNAVAILABLE")).alias("bad"),
    )
    g = per.groupBy(*keys).agg(
        (F.try_divide(F.sum(F.col("rel") * F.col("sup")), F.sum("rel"))).alias("_c"), F.count_if("observable").alias("observable"), F.count_if("supporting").alias("supporting"),
        F.count_if("contradicting").alias("contradicting"), F.bool_or("bad").alias("_bad"),
    )
    g = g.withColumn("confidence", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c"))), F.lit(0.0)))
    ambiguity = _codes(
        (F.col("contradicting") > 0, "CONTRADICTING_EVIDENCE"), (F.col("observable") < least_observable, "INSUFFICIENT_OBSERVABLE_CAMERAS"), (F.col("supporting") < least_supporting, "INSUFFICIENT_SUPPORT"),
        (F.col("confidence") < least_confidence, "LOW_CONFIDENCE"), (F.col("_bad"), "QA_UNUSABLE"),
    )
    refine = _codes((F.col("contradicting") > 0, "CONFLICT"), (F.col("_bad"), "QA"))
    return g.select(*keys, "confidence", "observable", "supporting", "contradicting", F.array_join(ambiguity, "+").alias("ambiguity"), F.array_join(refine, "+").alias("refine"))


def adjudicate(decisions: DataFrame, key: str, margin: float, abstain: bool = False) -> DataFrame:
    """key, id, verdict (FINAL or ABSTAINED) of each decision (id, start_ns,
    end_ns, confidence, resolved).

    Surest first: an unresolved decision abstains; one that overlaps decisions
    already final competes with them, and the surest (then the largest id)
    stays, unless another comes within the margin or `abstain` is set: then
    all of them abstain.  The choice is sequential, but decisions meet only
    within a run of overlapping ones, so each run is a group of its own."""
    w = Window.partitionBy(key).orderBy("start_ns", "end_ns", "id")
    reach = F.max("end_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = decisions.withColumn("_run", F.sum(F.when(reach.isNull() | (F.col("start_ns") >= reach), 1).otherwise(0)).over(w))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (-r.confidence, r.id))
        final, out = [], {}
        for r in rows:
            if not r.resolved:
                out[r.id] = "ABSTAINED"
                continue
            met = [f for f in final if f.start_ns < r.end_ns and r.start_ns < f.end_ns]
            group = [r, *met]
            winner = max(group, key=lambda x: (x.confidence, x.id))
            close = bool(met) and margin > 0 and any(abs(winner.confidence - x.confidence) <= margin for x in group if x.id != winner.id)
            final = [f for f in final if f not in met]
            for x in group:
                out[x.id] = "FINAL" if not met or (x.id == winner.id and not close and not abstain) else "ABSTAINED"
            final += [x for x in group if out[x.id] == "FINAL"]
        return pd.DataFrame({key: pdf[key].iloc[0], "id": list(out), "verdict": list(out.values())})

    kinds = {f.name: f.dataType.simpleString() for f in decisions.schema.fields}
    sized = runs.withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run")))
    alone = sized.filter("_n = 1").select(key, "id", F.when(F.col("resolved"), "FINAL").otherwise("ABSTAINED").alias("verdict"))
    return alone.unionByName(sized.filter("_n > 1").groupBy(key, "_run").applyInPandas(choose, f"{key} {kinds[key]}, id {kinds['id']}, verdict string"))


def tracks(hypotheses: DataFrame, key: str, gap: int) -> DataFrame:
    """key, track, label, start_ns, end_ns, n, state of event tracks.

    hypotheses: key, step, id, label, start_ns, end_ns.  Step by step each
    hypothesis, in order, goes to the open track of its label with the least
    gap to it (at most `gap`; then the oldest track), one to a track; a new
    track is OPEN, then UPDATED; an open track that a step leaves without a
    hypothesis is CLOSED."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[dict] = []
        live: list[dict] = []
        rows = pdf.sort_values(["step", "start_ns", "end_ns", "id"])
        for _, step in groupby(zip(rows["step"], rows["label"], rows["start_ns"], rows["end_ns"], strict=True), key=lambda r: r[0]):
            kept = []
            for _, label, start, end in step:
                near = [(far, t["track"]) for t in live if t["label"] == label and (far := max(0, start - t["end_ns"], t["start_ns"] - end)) <= gap]
                if near:
                    t = made[min(near)[1]]
                    t |= {"start_ns": min(t["start_ns"], start), "end_ns": max(t["end_ns"], end), "n": t["n"] + 1, "state": "UPDATED"}
                    live.remove(t)  # one hypothesis a track and step
                else:
                    t = {"track": len(made), "label": label, "start_ns": start, "end_ns": end, "n": 1, "state": "OPEN"}
                    made.append(t)
                kept.append(t)
            for t in live:
                t["state"] = "CLOSED"
            live = kept
        out = pd.DataFrame(made)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = hypotheses.schema[key].dataType.simpleString()
    return hypotheses.groupBy(key).applyInPandas(run, f"{key} {kind}, track long, label string, start_ns long, end_ns long, n long, state string")


def track_stream(hypotheses: DataFrame, key: str, gap: int) -> DataFrame:
    """The tracks of a stream, each micro-batch a step: changed tracks go out,
    open ones are kept as the key's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = hypotheses.schema[key].dataType.simpleString()

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, labels, starts, ends, ns = state.get if state.exists else ([], [], [], [], [])
        live = [dict(zip(("track", "label", "start_ns", "end_ns", "n"), t, strict=True)) for t in zip(ids, labels, starts, ends, ns, strict=True)]
        made, used = max(ids, default=-1) + 1, set()
        rows = pd.concat(list(pdfs)).sort_values(["start_ns", "end_ns", "id"])
        new = []
        for h in rows.itertuples(index=False):
            near = [(g, t["track"]) for t in live if t["label"] == h.label and t["track"] not in used and (g := max(0, h.start_ns - t["end_ns"], t["start_ns"] - h.end_ns)) <= gap]
            if near:
                t = next(t for t in live if t["track"] == min(near)[1])
                t |= {"start_ns": min(t["start_ns"], h.start_ns), "end_ns": max(t["end_ns"], h.end_ns), "n": t["n"] + 1}
                used.add(t["track"])
            else:
                new.append({"track": made, "label": h.label, "start_ns": h.start_ns, "end_ns": h.end_ns, "n": 1})
                made += 1
        out = [{**t, "state": "UPDATED" if t["track"] in used else "CLOSED"} for t in live] + [{**t, "state": "OPEN"} for t in new]
        kept = [t for t in live if t["track"] in used] + new
        state.update(tuple([t[c] for t in kept] for c in ("track", "label", "start_ns", "end_ns", "n")))
        yield pd.DataFrame([{key: k[0], **t} for t in out])

    out = f"{key} {kind}, track long, label string, start_ns long, end_ns long, n long, state string"
    held = "ids array<long>, labels array<string>, starts array<long>, ends array<long>, ns array<long>"
    return hypotheses.groupBy(key).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def provisional_actions(rows: DataFrame, keys: list[str], gap: int, least_cameras: int) -> DataFrame:
    """One row a component of intervals of a key that lie within `gap`: its
    envelope, the number of its parts, its cameras and its ambiguity."""
    from .intervals import islands

    g = islands(rows, keys, "start_ns", "end_ns", gap).groupBy(*keys, "island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n_parts"), F.array_sort(F.collect_set("camera")).alias("_c"))
    return g.withColumn("cameras", F.array_join("_c", ",")).withColumn("ambiguity", F.when(F.size("_c") < least_cameras, "SINGLE_CAMERA").otherwise("RESOLVED")).drop("_c")
