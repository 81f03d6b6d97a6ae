"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder the job starts in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    return builder.config(map=defaults | conf).getOrCreate()
