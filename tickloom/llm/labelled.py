"""Labelled rows for fitting classifiers: bounded samples, or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: A side of at most so many narrow rows is broadcast; a larger one is joined by shuffling.
SMALL_ROWS = 200_000
# What word hashes are mixed with for further minima.
MIXES = (0x1B873593CC9E2D51, 0x27D4EB2F165667C5, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x61C8864680B583EB, 0x369DEA0F31A53F85)


def fold(parts: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(0))


def _least() -> list[Column]:
    """Two minima of hashes of the text's words."""
    words = F.split(F.lower("text"), r"\s+")

    def least(k: int) -> Column:
        return F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(k)))).alias(f"least{k}")  # a second argument would be the word's place

    return [least(1), least(2)]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep: Column, rows: int, once: bool = False) -> DataFrame:
    """label, text of at most ``rows`` labelled rows, chosen by a hash of the id among those that ``keep``; the same at every run.

    An id labelled more than once counts with its largest label; null labels and ids are left out. Of rows with equal ids the
    one of the least text digest teaches. With ``once``, copies and near copies (two equal minima of word hashes) count as
    one row, that of the least hash of the id, so that a text copied often teaches no more than another.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(keep)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("copy"), "label", "text")).alias("of")).select("doc_id", "of.*")
    if once:
        sample = sample.groupBy(*_least()).agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "label", "text")).alias("of")).select("of.*")
    return sample.select("label", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, keep: Column) -> DataFrame:
    """label, text, minima of all labelled rows that ``keep`` keeps, chosen as :func:`labelled_sample` with ``once`` does but without a bound.

    ``minima`` holds eight minima of hashes of the text's words; near copies have most of them in common. Digests and hashes decide which rows teach, so that texts are read twice but not sorted: they cross the network at most once,
    and only where more than ``SMALL_ROWS`` rows teach.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(keep)
    known = saved(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    texts = docs.select("doc_id", whole_text().alias("text")).where(F.col("doc_id").isNotNull()).where(keep)
    copy = F.md5(F.col("text").cast("binary")).alias("copy")
    def narrow(df: DataFrame) -> DataFrame:
        hashed = df.select(*[c for c in df.columns if c != "text"], copy, *_least(), F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w)).alias("hashes"))
        mixed = lambda m: F.array_min(F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(m))))
        minima = F.array("least1", "least2", *[mixed(m) for m in MIXES])
        return hashed.select(*[c for c in hashed.columns if c != "hashes"], minima.alias("minima"))

    rows = narrow(texts.join(F.broadcast(known), "doc_id")) if known.count() <= SMALL_ROWS else narrow(texts).join(known, "doc_id")
    rows = rows.groupBy("doc_id", "copy").agg(F.min(F.struct("label", "least1", "least2", "minima")).alias("of"), F.count(F.lit(1)).alias("times"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("copy", "of", "times")).alias("of")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "of.copy", "of.of.*", "of.times")
    rows = rows.groupBy("least1", "least2").agg(F.min(F.struct("h", "doc_id", "copy", "label", "times", "minima")).alias("of")).select("of.*")
    rows = saved(rows, "teaching")
    found = texts.withColumn("copy", copy).join(F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows, ["doc_id", "copy"])
    if rows.where("times > 1").isEmpty():
        return found.select("label", "text", "minima")
    return found.where("times = 1").select("label", "text", "minima").unionByName(found.where("times > 1").dropDuplicates(["doc_id"]).select("label", "text", "minima"))
