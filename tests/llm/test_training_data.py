"""The training-data operators against brute force and odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessellar.llm import bpe, hnsw, html_extract, langid, lattice, licenses, mixing, simhash, token_counts
from tessellar.llm.common import components

ODD = [None, "", " ", "a  b", " a", "a ", "a\nb \n c", "▁a ▁ b", "x <s> </s> <|endoftext|> y", "\x00 é​ ñ\t", "it's  don't", "😀 " * 3, "word " * 9000]


def odd_docs(spark, extra="score double, size string, row int"):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", 1.0, "q", 5) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "null id", "en", "s", 1.0, "q", 5)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs(spark)
    got = token_counts.count_tokens(docs, path).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (len(model.encode(r.text or "")), len((r.text or "").encode()))
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = odd_docs(spark).coalesce(2)
    got = bpe.encode(docs, path, decoded=True).collect()
    want = sorted(np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes() for r in docs.collect())
    assert sorted(bytes(r.ids) for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(tok.decode(tok.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in docs.collect())
    again = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in got)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice((2, 5, 60, 200)))) for _ in range(120)]
    for t in texts[:40]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "\t", texts[0], texts[0].upper()]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.clusters(docs).collect()}
    fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(label[j] for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4)) for i in range(len(texts))]
        if new == label:
            break
        label = new
    assert [got[i * 3].component_id for i in range(len(texts))] == [x * 3 for x in label]
    assert simhash.keep_one(docs).count() == len(set(label))
    assert simhash.clusters(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:200] = x[:100] + 0.02 * rng.standard_normal((100, dim))
    x[200:260] = x[7] + 0.05 * rng.standard_normal((60, dim))
    x[260:280] = x[9]
    return x


ODD_VECTORS = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (None, [1.0] * 16), (9006, [1.0] * 3)]


def vector_table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(a, b, 1) for a, b in ODD_VECTORS], "vec_id long, embedding array<double>, n_links int")


def test_lattice_links(spark):
    x = vectors()
    got = {r.vec_id: r for r in lattice.near_duplicates(vector_table(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    for i, _ in ODD_VECTORS[:5]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert {got[i].component_id for i in range(260, 280)} == {got[9].component_id}
    assert lattice.near_duplicates(vector_table(spark, x).limit(0)).count() == 0


def test_lattice_points_are_nearest():
    y = np.random.default_rng(0).normal(0, 2, (500, 8))
    d = ((y - lattice.e8(y)) ** 2).sum(axis=1)
    assert d.max() <= 1 + 1e-9 and (d[:, None] <= ((y[:, None] - lattice.e8(y)[:, None] - lattice.ROOTS) ** 2).sum(axis=2) + 1e-9).all()


def test_nearest_vectors_recall(spark):
    x = vectors(3000, 32, 5)
    table = vector_table(spark, x).withColumn("n_links", F.lit(None))
    got = hnsw.nearest(table, table.filter("vec_id % 20 = 0"), k=10, shard_rows=1000).toPandas()
    hits = n = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:10]
        hits += len(set(want) & set(g.vec_id))
        n += 10
        assert list(g.sort_values("rank").score) == sorted(g.score, reverse=True)
    assert n == 1500 and hits / n >= 0.95
    assert hnsw.nearest(table, table.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 20)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [(9000, None, "a"), (9001, " \t", "empty"), rows[0]]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))).toPandas()
    assert len(got) == len(rows) and (got["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in got.text]).all()
    assert abs(got.groupby("source", dropna=False).target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    for _, g in got[got["size"] > 0].groupby("source", dropna=False):
        assert abs(g.taken.sum() / g.target.iloc[0] - 1) < 0.01 and g.target.iloc[0] <= 3 * g["size"].sum() + 1e-6
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_licenses_own_and_inherited(spark):
    rows = [
        ("p/LICENSE", "Released under the MIT License."), ("p/q/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("p/a.py", "x\nAll rights reserved.\ny"), ("p/b.py", "code"), ("p/q/r/s/c.py", None), ("z/d.py", ""), ("top.py", "und mit der"), (None, "x"), ("p/b.py", "code"),
    ]
    got = {r.path: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string").withColumn("score", F.lit(1))).collect()}
    assert got == {
        "p/LICENSE": ("MIT", "own"), "p/q/COPYING.txt": ("Apache-2.0", "own"), "p/a.py": ("All-Rights-Reserved", "own"), "p/b.py": ("MIT", "inherited"),
        "p/q/r/s/c.py": ("Apache-2.0", "inherited"), "z/d.py": (None, "none"), "top.py": (None, "none"),
    }
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_language(spark):
    en, de = "the quick brown fox jumps over this lazy dog and then some", "der schnelle braune fuchs springt über den faulen hund und weiter"
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample((en if i % 2 else de).split(), 8)), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !", "en"), (902, en * 20000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(docs, learn=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "en")
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.fit(docs.limit(0)).predict(["x"])[0] == ["und"]


def test_main_text(spark):
    page = "<html><head><title>t</title><script>x('</p>')</script></head><body><nav><ul><li><a href=/>menu one</a></li><li><a href=/>menu two</a></li></ul></nav><div class='ad'>buy this now</div><article><h1>Head &amp; line</h1><p><b>First   words of it, some.<br><p>Second words &eacute;, more of them.</p></article><footer>&copy; site</footer></body></html>"
    rows = [(i, f"u{i}", page.replace("words", f"words {i}")) for i in range(40)] + [(50, None, None), (51, "e", ""), (52, "p", "no markup < at all")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = {r.page_id: r.text for r in html_extract.extract(pages, html_extract.fit(pages)).collect()}
    assert got[3] == "Head & line\nFirst words 3 of it, some.\nSecond words 3 é, more of them." and got[50] == got[51] == ""
    assert html_extract.extract(pages.limit(0), html_extract.Labeller()).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and all(hashlib.sha256((raw[r.doc_id] or "").encode()).hexdigest() == r.decoded_sha256 for r in got)
    assert max(np.unique([r.doc_id for r in got], return_counts=True)[1]) <= 3


@pytest.mark.parametrize("n", [2, 10, 1000, 10**6, 10**9])
def test_any_near_pair_shares_a_block_key(n):
    rng = random.Random(n)
    masks = simhash.block_masks(n, 4)
    for _ in range(50):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)
