"""From raw documents to shards: each stage works on all that the one before kept.

Every stage but the last returns the columns of ``documents``. Between stages the rows
are written as Parquet in the shared folder and read again, so that a lost executor
costs the stage it worked on at most.

Cases: null texts count as empty, are clean and stay (copies of each other, so one of
them); a null id joins the class of its text; null sources are one source; columns beside
those of ``documents``, whatever their names, pass through the first four stages; empty
tables make no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import saved, table, unused
from tickloom.llm.decontamination import COVER, tile_documents
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.near_dup import without_near_duplicates
from tickloom.llm.sharding import shard_documents
from tickloom.llm.toxicity import fit_toxicity, score_toxicity

#: Documents that score so much or more are rejected as toxic.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic threshold; null and empty texts stay."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "toxic_score")
    return score_toxicity(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the least id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled from to ``COVER`` or more."""
    names = tuple(unused(docs, "item_id", "coverage", "items"))
    return tile_documents(docs, table(spark, sf_dir, "benchmark"), names=names).where(F.col(names[1]) < COVER).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole; those it takes less than half of go."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can express neither the first three stages nor, therefore, the rows that reach the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
