"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the executors through Spark's own file server, once an application."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "code", root.name)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="gleanspark-code-"), f"{root.name}-code")), "zip", copy.parent)
    spark.sparkContext.addPyFile(archive)


def shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run
