"""Functions in workers that have run nothing before."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellar.llm import langid

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(3).withColumn("text", F.lit("ab"))
model = langid.Model([], np.zeros((1 << langid.BITS, 0)), np.zeros(0))
assert [(r.id, r.lang_pred) for r in langid.predict(docs, model).collect()] == [(i, "und") for i in range(3)]
print("as wanted")
"""


def test_language_is_predicted_by_a_fresh_worker():
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=200)
    assert "as wanted" in done.stdout, done.stderr[-2000:]
