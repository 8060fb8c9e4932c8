"""Send the package to the executors, where their Python can't find it by itself."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application. Workers find the package alone if they start in its folder or PYTHONPATH names it."""
    app = spark.sparkContext.applicationId
    named = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or ROOT in named or os.path.realpath(os.getcwd()) == os.path.realpath(ROOT):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, folders, files in os.walk(os.path.join(ROOT, "skein")):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    own = os.path.join(top, name)
                    archive.write(own, os.path.relpath(own, ROOT))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(query):
    """A query of (spark, sf_dir) that ships the package first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
