"""The queries that apply the operators to the test tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, html_extract, langid, lattice, licenses, mixing, simhash, token_counts, toxicity
from .common import crc32_mod


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.json")
    # larger blocks than the default name fewer words twice: less is shuffled, for more memory
    out = bpe.encode(_read(spark, sf_dir, "documents"), path, decoded=True, block=2 * bpe.BLOCK)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id div 500/doc_id; every fiftieth is
    a licence file of its source/lang, LICENSE.doc_id."""
    place = F.concat_ws("/", "source", "lang")
    i = F.col("doc_id").cast("string")
    return docs.select(F.when(F.col("doc_id") % 50 == 0, F.concat(place, F.lit("/LICENSE."), i)).otherwise(F.concat_ws("/", place, F.expr("cast(doc_id div 500 as string)"), i)).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a licence inherit that of the best licence file of their source and language."""
    found = licenses.scan(_files(_read(spark, sf_dir, "documents")))
    return found.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), "how")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    index = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=~held_out)
    scored = toxicity.score(docs, index, evidence=True)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "neighbours", "cosines", "their_labels")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, learn=~held_out)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.filter("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lattice_near_duplicates, op2_token_counts, op3_bpe_round_trip, op4_mixing, op5_license_scan, op6_toxicity, op7_language, op8_main_text, op9_simhash, op10_nearest_vectors)
}


def _license_sql() -> str:
    """Weights are worked out here from the notices alone, every line is scored, and directories are looked up level by level."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notices = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, v in sorted(licenses.TEMPLATES.items()) for t in v)

    def running(phrases: tuple[str, ...]) -> str:
        return "(^|[^a-z0-9])(" + "|".join(sorted({"[^a-z0-9]+".join(re.findall(licenses.WORD, p.lower())) for p in phrases})) + ")([^a-z0-9]|$)"

    windows = ", ".join(f"({quoted(k)}, {quoted(running((*licenses.TEMPLATES.get(k, ()), *licenses.PHRASES.get(k, ()))))})" for k in sorted({*licenses.TEMPLATES, *licenses.PHRASES}))
    return f"""
WITH notices AS (SELECT row_number() OVER () AS k, * FROM (VALUES {notices}) v(license, notice)), phrases(license, pattern) AS (VALUES {windows}),
tc AS (SELECT k, term, count(*) AS c FROM (SELECT k, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM notices) GROUP BY ALL),
idf AS (SELECT term, ln((1e0 + (SELECT count(*) FROM notices)) / (1e0 + count(*))) + 1e0 AS idf FROM tc GROUP BY term), unknown AS (SELECT ln(1e0 + count(*)) + 1e0 AS u FROM notices),
tw AS (SELECT k, term, c * idf AS x FROM tc JOIN idf USING (term)), w AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS weight FROM tw),
files AS (SELECT doc_id, source || '/' || lang AS top, CASE WHEN doc_id % 50 = 0 THEN concat_ws('/', source, lang) || '/LICENSE.' || doc_id ELSE concat_ws('/', source, lang, CAST(doc_id // 500 AS VARCHAR), CAST(doc_id AS VARCHAR)) END AS path, concat_ws('/', source, lang) AS dir, doc_id % 50 = 0 AS is_license, text FROM documents),
numbered AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files UNION ALL SELECT path, text, -1 FROM files WHERE is_license AND text IS NOT NULL),
counted AS (SELECT path, line_no, term, count(*) AS c FROM (SELECT path, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM numbered) GROUP BY ALL),
weighed AS (SELECT path, line_no, counted.term, c * coalesce(idf, u) AS x FROM counted LEFT JOIN idf ON idf.term = counted.term, unknown),
norms AS (SELECT path, line_no, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL), dots AS (SELECT path, line_no, k, sum(x * weight) AS dot FROM weighed JOIN w ON w.term = weighed.term GROUP BY ALL),
hits AS (SELECT path, license, round(dot / norm, 9) AS score FROM dots JOIN norms USING (path, line_no) JOIN notices USING (k) WHERE round(dot / norm, 9) >= {licenses.LEAST} UNION ALL SELECT path, license, 1e0 FROM files JOIN phrases ON regexp_matches(lower(text), pattern)),
best AS (SELECT path, license, score FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY license = '{licenses.RIGHTS}', score DESC, license DESC) = 1),
given AS (SELECT dir, license, score FROM files JOIN best USING (path) WHERE is_license QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1)
SELECT doc_id, path, coalesce(b.license, g.license) AS license, round(coalesce(b.score, g.score, 0.0), 6) AS score, CASE WHEN b.license IS NOT NULL THEN 'own' WHEN g.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM files f LEFT JOIN best b USING (path) LEFT JOIN given g ON g.dir = f.dir
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": _license_sql()}
