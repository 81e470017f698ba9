"""Session settings for tests and benches; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


ROOT = str(Path(__file__).resolve().parents[1])


def findable(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers find this package, wherever the session was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, ANSI left on)."""
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tonalis")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
