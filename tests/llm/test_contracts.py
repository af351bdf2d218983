"""Names, order and types of the queries' first columns, and operators against plain versions of themselves."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessellar.llm import bpe, html_extract, langid, mixing, queries, simhash

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_lattice_near_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_nearest_vectors": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_queries(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = CONTRACT[name].count(",") + 1
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:n]) == CONTRACT[name]


def test_columns_of_the_mix(spark):
    got = {f.name: f.dataType.simpleString() for f in queries.op4_mixing(spark, SF).schema.fields}
    assert {k: got[k] for k in ("doc_id", "size", "source_size", "target", "taken")} == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}


def test_bpe_of_equal_files_and_long_texts(spark, tmp_path):
    """Partitions with the same rows, and texts longer than a block."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = bpe.load(path)
    rng = random.Random(5)
    long_text = " ".join(rng.choice(["é", "word", "\n", " ", "x<|endoftext|>y", "\x01", "😀"]) for _ in range(40_000))
    rows = [(1, "the same rows"), (2, long_text), (2, None), (3, "a" * 3000), (4, "x" + " " * 3000 + "y")]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one.write.parquet(str(tmp_path / "t"))
    one.write.mode("append").parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    want = sorted((i, np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in rows * 2)
    for block in (bpe.BLOCK, 5000):
        got = bpe.encode(docs, path, decoded=True, block=block, buckets=5).collect()
        assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want


def test_rates_are_those_of_a_plain_dual(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "a", "b", None]), "h", 1.5) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h string, mean double").withColumn("lam", F.lit(2)).withColumn("Taken", F.lit("x")).withColumn("row", F.lit(3))
    got = mixing.mix(docs).toPandas()
    assert set(docs.columns) - {"Taken"} <= set(got.columns) and (got["h"] == "h").all() and (got["mean"] == 1.5).all()
    sizes = {s: [x for x, y in zip(got["size"], got["source"].fillna("~"), strict=True) if y == s] for s in ("a", "b", "~")}
    total, weights = sum(map(sum, sizes.values())), {"a": 5.0, "b": 2.0, "~": 1.0}
    goal, open_ = {}, dict(weights)
    while True:  # share, cap, share anew
        left = total - sum(goal.values())
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 3 * sum(sizes[s])]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * sum(sizes[s])
            del open_[s]
    goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s, own in sizes.items():
        here = got[got["source"].fillna("~") == s]
        assert abs(here["target"].iloc[0] - goal[s]) < 1e-6 * goal[s] and (here["source_size"] == sum(own)).all()
        lo, hi = -1.0, 1.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lo, lam) if sum(x * min(3.0, math.exp(lam * x)) for x in own) > goal[s] else (lam, hi)
        some = here[here["size"] > 0]
        assert np.allclose(some["rate"], np.minimum(3, np.exp(lo * some["size"])), rtol=1e-5, atol=1e-6)
        assert ((some["copies"] - some["rate"]).abs() < 1).all() and (some["copies"] <= 3).all()
        assert abs(here["taken"].sum() - goal[s]) <= 0.01 * goal[s]
    again = mixing.mix(docs.repartition(9)).select("doc_id", "copies").toPandas()
    assert dict(zip(again.doc_id, again.copies, strict=True)) == dict(zip(got.doc_id, got.copies, strict=True))


def test_rates_that_do_not_settle_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix(docs)


def test_language_is_that_of_a_plain_naive_bayes(spark):
    rng = random.Random(3)
    words = {"en": "the quick brown fox jumps over this dog".split(), "de": "der schnelle braune fuchs über dem hund".split(), "fr": "le renard été vif sur ce chien".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=4)) + rng.choice(["", "  !", "\n12 "]), k) for i, k in enumerate(rng.choices(list(words), k=150))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        c = "".join(x if x.isalpha() else " " for x in text.lower())
        return [c[i : i + n] for n in langid.SIZES for i in range(len(c) - n + 1) if c[i : i + n].strip()]

    hashed = {}

    def feature(g):
        if g not in hashed:
            h = 0
            for ch in g:
                h = (h ^ ord(ch)) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            hashed[g] = (h ^ (len(g) * 0x85EBCA6B) % 2**32) >> (32 - langid.BITS)
        return hashed[g]

    counts, docs = defaultdict(Counter), Counter()
    for _, t, k in rows:
        counts[k].update(map(feature, grams(t)))
        docs[k] += 1
    for t in ["the hund été", "fox fuchs", "Der, QUICK renard", *[t for _, t, _ in rows[:30]]]:
        logs = {k: math.log(docs[k] / len(rows)) + sum(math.log((counts[k][f] + langid.SMOOTH) / (counts[k].total() + langid.SMOOTH * 2**langid.BITS)) for f in map(feature, grams(t))) for k in words}
        best = max(logs, key=logs.get)
        (got,), score = model.predict([t])
        assert got == best and abs(score[0] - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-3


def test_language_counts_no_ngram_twice_at_seams(monkeypatch):
    def held(text):
        return Counter(x for _, _, f in langid._features([text]) for x in f.tolist() if x != 1 << langid.BITS)

    text = "añb cd  e f" * 5 + "  zz"
    whole = held(text)
    for piece in (1, 2, 3, 5, 8):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert held(text) == whole


def test_a_tie_between_languages_goes_to_the_first(spark):
    rows = [(1, "aaa bbb", "xx"), (2, "aaa bbb", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["aaa", "qqq"])[0] == ["xx", "xx"]


def test_forward_pass_and_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller(width=5, units=3)
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (1, 4, 7)]

    def plain(x):
        sides = []
        for d in ("f", "b"):
            h, c, out = np.zeros(3), np.zeros(3), [None] * len(x)
            for t in range(len(x)) if d == "f" else reversed(range(len(x))):
                z = x[t] @ model.w[f"x{d}"] + model.w[f"c{d}"] + h @ model.w[f"h{d}"]
                i, f, o = (1 / (1 + np.exp(-z[k : k + 3])) for k in (0, 3, 6))
                c = f * c + i * np.tanh(z[9:])
                h = o * np.tanh(c)
                out[t] = h
            sides.append(out)
        return [1 / (1 + np.exp(-(np.concatenate([a, b]) @ model.w["out"] + model.w["bias"][0]))) for a, b in zip(*sides, strict=True)]

    for p, x in zip(model.probabilities(pages), pages, strict=True):
        assert np.allclose(p, plain(x), atol=1e-5)
    labels = [rng.integers(0, 2, len(x)).astype(np.float32) for x in pages]
    grads = model.gradients(pages, labels)

    def loss():
        return sum(-(y * np.log(q) + (1 - y) * np.log(1 - q)) for x, l in zip(pages, labels, strict=True) for q, y in zip(map(float, plain(x.astype(float))), l, strict=True)) / sum(map(len, pages))

    for name, w in model.w.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            was, e = w[at], 1e-3
            w[at] = was + e
            up = loss()
            w[at] = was - e
            down = loss()
            w[at] = was
            assert abs((up - down) / (2 * e) - grads[name][at]) < 2e-3


def test_one_of_each_group_stays_whatever_the_columns(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (3, "other words in here now", "z"), (None, "a b c d e", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").withColumn("component_id", F.lit(9))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.kept_id) for r in got.collect())) == [(0, "n"), (1, "x"), (3, "z")]
    found = simhash.clusters(docs).collect()
    assert len(found) == 5 and all(r.component_id == 1 for r in found if r.doc_id != 3)


def test_white_space_is_ascii_only():
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in ("a\x0bb\x1cc", "\x85 a")] == [2, 2]
