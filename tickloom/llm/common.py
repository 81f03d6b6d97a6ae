"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

#: Bytes of one Arrow batch sent to a Python worker; rows of any length then fit its memory.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"checkpoint-{spark.sparkContext.applicationId}")  # one process: its own folder is shared
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_base(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that very long texts cannot fill a worker."""
    reachable(spark)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now is None or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
