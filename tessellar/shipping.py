"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a Spark application, unless
    PYTHONPATH, which workers inherit, already leads to it."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    if any(p and Path(p).resolve() == _HERE.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    with tempfile.TemporaryDirectory() as made:
        stage = Path(made) / "stage"
        shutil.copytree(_HERE, stage / _HERE.name, ignore=shutil.ignore_patterns("__pycache__"))
        # Spark's file server copies the archive when it is added
        keep = Path(tempfile.mkdtemp(prefix="tessellar-code-"))
        context.addPyFile(shutil.make_archive(str(keep / f"{_HERE.name}-code"), "zip", stage))
