"""What counts as a copy when words are weighed, and what the calibrated index answers."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessellar.llm import toxicity


def learnt(texts, labels):
    return toxicity.learn_index(toxicity.Sample.of([toxicity.words(t) for t in texts]), labels, list(range(len(texts))), [toxicity.sketch(t) for t in texts])


def answers(index, texts):
    return index.probability(np.array([e[0] for e in index.evidence([toxicity.words(t) for t in texts])]))


def test_texts_that_share_their_ends_are_not_copies():
    rng = random.Random(6)
    head, foot = "Copyright notice that stands above every document of this corpus. " * 2, " And the footer that stands below every document of this corpus." * 2
    words = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(300):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            w[::9] = rng.choices(["vile", "foul"], k=len(w[::9]))
        texts.append(head + " ".join(w) + foot)
        labels.append(int(i % 5 == 0))
    assert (answers(learnt(texts, labels), texts) >= 0.5).astype(int).tolist() == labels


def test_a_toxic_edit_of_a_clean_text_is_no_copy():
    clean = " ".join(f"w{i}" for i in range(200))
    texts = [clean, clean.replace("w100 ", "vile "), clean.upper(), clean.replace("w7 ", "other ")]
    assert toxicity.copies([toxicity.sketch(t) for t in texts], [0, 1, 0, 0]) == [[0, 2, 3], [1]]


def test_copies_count_once_and_rare_words_find_their_copies():
    rng = random.Random(8)
    other = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=50)) for _ in range(200)]
    base = " ".join(f"calm{i}" for i in range(100))
    other += [" ".join([*rng.choices([f"w{i}" for i in range(300)], k=50), "vile"]) for _ in range(30)]
    texts = [*other, *[base.replace("calm50 ", f"edit{i} ") for i in range(100)]]
    labels = [*[0] * 200, *[1] * 130]
    groups = toxicity.copies([toxicity.sketch(t) for t in texts], labels)
    assert max(map(len, groups)) == 100 and sum(map(len, groups)) == 330
    index = learnt(texts, labels)
    # no word of the group of copies is held by many groups, but a copy still meets them all
    (near, cosine), = index.nearest([index.vector(toxicity.words(base))])
    assert index.labels[near].all() and cosine[0] > 0.9
    alone = learnt([*other, "rare1 rare2 rare3 rare4"], [*labels[:230], 1])
    (near, cosine), = alone.nearest([alone.vector(toxicity.words("rare4 rare3 rare2 rare1"))])
    assert abs(cosine[0] - 1) < 1e-12 and alone.ids[near[0]] == 230


def test_nearest_are_those_of_brute_force_ties_in_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(700):
        w = rng.choices(words, k=rng.choice((3, 60, 400)))
        if i % 5 == 0:
            w[::9] = rng.choices(["vile", "foul", "nastyish"], k=len(w[::9]))
        texts.append(" ".join(w))
    texts += [texts[0]] * 40 + ["", "w1"]  # more equal texts than neighbours
    labels = [int(i % 5 == 0) for i in range(len(texts))]
    labels[700:740] = [1] * 40
    index = learnt(texts, labels)
    dense = np.zeros((len(index.labels), len(index.idf)))
    for i in range(len(index.labels)):
        dense[i, index.of[index.begins[i] : index.begins[i + 1]]] = index.weight[index.begins[i] : index.begins[i + 1]]
    asked = [index.vector(toxicity.words(t)) for t in [*texts[:80], texts[0], "", "unknown", "w1 vile", "w7 " * 30_000]]
    for (t, v), (near, cosine) in zip(asked, index.nearest(asked), strict=True):
        want = np.round(dense[:, t] @ v, 9)
        order = np.argsort(-want, kind="stable")[: toxicity.NEIGHBOURS]
        order = order[want[order] > 0]
        assert np.allclose(cosine, want[order]) and (np.round(cosine, 9) == want[order]).all() and near.tolist() == order.tolist()


def test_reruns_agree_and_odd_rows_are_scored(spark):
    rng = random.Random(5)
    rows = [(i, " ".join([*rng.choices([f"w{k}" for k in range(200)], k=40), *(["vile", "foul"] * (i % 4 == 0))]), "x") for i in range(400)]
    rows += [(700, None, None), (701, "", None), (None, "vile foul", None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Predicted string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = [sorted((r.doc_id or -1, r.score, r.predicted, tuple(r.neighbours)) for r in toxicity.score(d, toxicity.fit(d, labels), evidence=True).collect()) for d in (docs, docs.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(p == int(i % 4 == 0) for i, _, p, _ in got[0] if 0 <= i < 400)
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert [r.score for r in toxicity.score(docs, empty).collect()] == [0.0] * len(rows)
    assert toxicity.score(docs.limit(0), empty).count() == 0
    one_class = toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, one_class).collect())
