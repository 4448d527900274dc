"""A session with the settings the engine is written for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def workers_find_package(spark: SparkSession) -> None:
    """Python workers started from now on import this package, also when the driver runs from another folder."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def get_session(name: str = "papyra", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive plans. Further settings as keywords, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
