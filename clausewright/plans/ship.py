"""Python workers must be able to import this package."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Put the folder of this package on the workers' path, in case the session was made without it."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the workers' path set first."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return query(spark, folder)

    return run
