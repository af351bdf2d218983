"""What the driver's Python process holds after learning from a sample."""

from pyspark.sql import functions as F

from tessellar.llm import toxicity


def test_memory_of_the_sample_is_given_back_once_the_index_stands(spark, monkeypatch):
    seen = []
    learnt, back = toxicity.learn_index, toxicity.give_back
    monkeypatch.setattr(toxicity, "learn_index", lambda *a: seen.append("learnt") or learnt(*a))
    monkeypatch.setattr(toxicity, "give_back", lambda: seen.append("given back") or back())
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word and "), F.col("id")).alias("text"))
    index = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert seen == ["learnt", "given back"] and len(index.labels) == 40
