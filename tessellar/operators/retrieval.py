"""Retrieval: the revision index, structured filters, lexical, vector and reranked pages, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import length_prefixed

USABLE = ("PASS", "SUPPORTING", "PARTIAL", "USABLE")
#: Most rows of a page, and of the candidates that are reranked.
MOST = 1000


def normalise(rows: DataFrame, statuses: str, text: list[str]) -> DataFrame:
    """rows with usable_camera_count (of a map of camera statuses) and
    search_text (the texts in lower case, joined); an empty interval or a
    confidence outside [0, 1] is an error."""
    n = F.size(F.filter(F.map_values(statuses), lambda s: s.isin(*USABLE)))
    ok = (F.col("start_ns") < F.col("end_ns")) & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
    checked = F.when(ok, F.lower(F.concat_ws(" ", *text))).otherwise(F.raise_error(F.lit("an event has an empty interval or a confidence outside [0, 1]")))
    return rows.withColumn("usable_camera_count", n).withColumn("search_text", checked)


def matches(filters: dict) -> Column:
    """The conjunction of the filters that are given: equal (column -> value),
    start_min, start_max, end_min, end_max (inclusive), min_confidence (null
    fails), min_usable, statuses (camera -> status)."""
    c, out = F.col, F.lit(True)
    for k, v in filters.get("equal", {}).items():
        out = out & c(k).eqNullSafe(F.lit(v))
    for name, test in (("start_min", lambda v: c("start_ns") >= v), ("start_max", lambda v: c("start_ns") <= v), ("end_min", lambda v: c("end_ns") >= v), ("end_max", lambda v: c("end_ns") <= v)):
        if filters.get(name) is not None:
            out = out & test(filters[name])
    if filters.get("min_confidence") is not None:
        out = out & F.coalesce(c("confidence") >= filters["min_confidence"], F.lit(False))
    if filters.get("min_usable") is not None:
        out = out & (c("usable_camera_count") >= filters["min_usable"])
    for camera, status in filters.get("statuses", {}).items():
        out = out & F.coalesce(F.try_element_at("camera_statuses", F.lit(camera)) == status, F.lit(False))
    return out


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)")))


def lexical(df: DataFrame, text: str, query: list[str]) -> DataFrame:
    """df with lexical, the share of the query's words that the text has; 0 goes."""
    q = F.array(*[F.lit(w) for w in dict.fromkeys(query)])
    share = F.size(F.array_intersect(tokens(F.col(text)), q)) / F.size(q)
    return df.withColumn("lexical", share).filter("lexical > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot / n)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    if not 0 < limit <= MOST:
        raise ValueError("a page has 1 to 1000 rows")
    return df.orderBy(*order).offset(offset).limit(limit)


def counted_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with total, the rows there are, and has_more."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return page(df, order, offset, limit).crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)


def rerank(candidates: DataFrame, hits: DataFrame | None, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the first MOST candidates (id) by the greatest score of each
    one's hits (id, score), none being -1, ties in their structured order; the
    page is cut after that.  No hits at all (null: the vectors failed): the
    structured page."""
    first = candidates.orderBy(*order).limit(MOST)
    ranked = first.withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # at most MOST rows
    if hits is None:
        return ranked.filter((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).withColumn("semantic_score", F.lit(None).cast("double")).drop("_place")
    best = hits.join(F.broadcast(ranked.select("id")), "id", "left_semi").groupBy("id").agg(F.max("score").alias("semantic_score"))
    j = ranked.join(best, "id", "left").withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("semantic_score", F.lit(-1.0))), "_place")))
    return j.filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).drop("_place", "_rank")


def vector_search(vectors: DataFrame, query: list[float], tenant: Column, candidates: DataFrame | None, least: float, limit: int) -> DataFrame:
    """id, score of the READY vectors (id, vector, state, tenant) of a tenant,
    among the candidates if given, nearest first."""
    v = vectors.filter((F.col("state") == "READY") & (F.col("tenant") == tenant))
    if candidates is not None:
        v = v.join(candidates.select("id").distinct(), "id", "left_semi")
    s = v.select("id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return s.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def conflicts(log: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that came with more than one content: a revision never changes."""
    return log.groupBy(key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).filter("_a <> _b").select(key)


def build_index(revisions: DataFrame, selections: DataFrame, event: str, revision: str, sequence: str, digest: str) -> DataFrame:
    """The current revision of each event: that of its last selection.  A
    revision with two contents, a selection of an unknown revision, or a log
    with holes in its sequence (0, 1, ...) is an error."""
    w = Window.partitionBy(event)
    s = selections.withColumn("_last", F.max(sequence).over(w)).withColumn("_holes", (F.max(sequence).over(w) + 1 != F.count("*").over(w)) | (F.min(sequence).over(w) != 0)).filter(F.col(sequence) == F.col("_last"))
    r = revisions.groupBy(revision).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"), F.first(F.struct(*[c for c in revisions.columns if c != revision])).alias("_row"))
    j = s.select(event, revision, "_holes").join(r, revision, "left")
    bad = F.when(F.col("_holes"), F.raise_error(F.lit("a selection log has holes"))).when(F.col("_row").isNull(), F.raise_error(F.lit("an unknown revision was selected"))).when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("a revision came with two contents")))
    return j.withColumn("_ok", F.coalesce(bad.cast("string"), F.lit("ok"))).filter("_ok = 'ok'").select(event, revision, *[F.col("_row").getField(c).alias(c) for c in revisions.columns if c not in (event, revision)])


def append(index: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """The rows of the batch that the index lacks, once each; the same key with
    another digest, in the batch or the index, is an error."""
    both = batch.select(key, digest).unionByName(index.select(key, digest))
    clash = conflicts(both, key, digest).limit(1).count()
    if clash:
        raise ValueError(f"a {key} came with two contents")
    return batch.dropDuplicates([key]).join(index.select(key), key, "left_anti")


def resolve_identity(rows: DataFrame, known: DataFrame, fingerprint: list[str], namespace: str) -> DataFrame:
    """rows with event_id and reused: that of the same fingerprint, exactly, if
    it is known (key, event_id); else one made from it, the same at every run
    (SHA-1 name-based, laid out as a version 5 UUID)."""
    key = length_prefixed(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fingerprint])
    space = F.lit(uuid.uuid5(uuid.NAMESPACE_URL, namespace).bytes)
    h = F.sha1(F.concat(space, key.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    j = rows.withColumn("_key", key).join(known.select(F.col("key").alias("_key"), F.col("event_id").alias("_known")), "_key", "left")
    return j.withColumn("event_id", F.coalesce("_known", made)).withColumn("reused", F.col("_known").isNotNull()).drop("_key", "_known")


def identity_relations(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """old_id, new_id, relation of intervals (id, start_ns, end_ns) that meet:
    SPLIT if the old one meets several, MERGE if the new one does, SUPERSEDES
    if it is one to one with the same bounds, else POSSIBLE_MATCH."""
    from .intervals import overlap_join

    a = before.select(*keys, F.col("id").alias("old_id"), F.col("start_ns").alias("a_start"), F.col("end_ns").alias("a_end"))
    b = after.select(*keys, F.col("id").alias("new_id"), F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    hit = overlap_join(a, b, keys, 600_000_000_000)
    n_old, n_new = F.count("*").over(Window.partitionBy("old_id")), F.count("*").over(Window.partitionBy("new_id"))
    same = (F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end"))
    hit = hit.withColumn("_o", n_old).withColumn("_n", n_new)
    return hit.select("old_id", "new_id", F.when(F.col("_o") > 1, "SPLIT").when(F.col("_n") > 1, "MERGE").when(same, "SUPERSEDES").otherwise("POSSIBLE_MATCH").alias("relation"))


def embedding_queue(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no finished embedding (key, state) answers: new ones PENDING, failed ones RETRY."""
    last = done.select(key, F.col("state").alias("_state"))
    return items.join(last, key, "left").filter("_state is null or _state <> 'READY'").withColumn("state", F.when(F.col("_state") == "FAILED", "RETRY").otherwise("PENDING")).drop("_state")
