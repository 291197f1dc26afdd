"""The package for executors that would not find it by themselves."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import lumenfold

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(lumenfold.__file__)))


def ensure(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless the Python path or the working folder already holds it."""
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in on_path or os.getcwd() == ROOT or getattr(sc, "_lumenfold", False):
        return
    made = tempfile.mkdtemp(prefix="lumenfold-")
    shutil.copytree(os.path.join(ROOT, "lumenfold"), os.path.join(made, "src", "lumenfold"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(made, "lumenfold"), "zip", os.path.join(made, "src")))
    sc._lumenfold = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ensure(spark)
        return query(spark, folder)

    return run
