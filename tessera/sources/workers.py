"""Python functions on executors: what they need to import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship() -> None:
    """Let Python workers that start from now on import this package; on a cluster give it with --py-files instead."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(":")
        if ROOT not in paths:
            env["PYTHONPATH"] = ":".join(x for x in [ROOT, *paths] if x)
