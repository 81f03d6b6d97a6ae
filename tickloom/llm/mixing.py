"""Mixing sources to target weights by a low-discrepancy schedule (operator 4), native.

Multiples of the golden ratio, taken modulo 1, run through the sources' cumulative
weights: each slot of the schedule names a source, and its rank among that source's
slots names a block. A source's documents, shuffled by a hash of their id and laid end
to end (again for a second and third pass), are cut into blocks of equal word counts;
slots and blocks are joined on (source, rank).

Targets fill like water: by weight, no source above ``passes`` times its own words.
The last block of a source ends where its target does, ranks beyond it are skipped and
ranks that the points did not reach come at the end, so every source's words equal its
target to the nearest word.

A source's shuffled rows are ranges of one order, dealt by key so that neither a hot source nor
a hot id meets in one task; sums of the ranges give each row its first word. Sources
themselves are one narrow row each, in one task.

Cases: null and blank texts have no words and are taken 0 times; null sources are one
source, sorted last; rows of equal ids and equal rows are laid out one after another; an empty
table makes no row; sources without words have target 0; other columns are ignored or pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, unused, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
PASSES = 3
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Cells of the unit interval on which slots meet sources, and slots counted together.
CELLS, CHUNK = 4096, 65536
#: A side of at most so many rows is broadcast; a larger one is joined by shuffling.
SMALL_ROWS = 50_000


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins a table read back from the shared folder, broadcast only if counted small."""
    return left.join(F.broadcast(right) if right.count() <= SMALL_ROWS else right, on, how)


def source_targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """``sizes(source, size)`` to src (0.. by code point, null last), source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, by_ratio = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        per.withColumn("src", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.col("src") % 3 + 1)
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("left_weights", F.col("weights") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0)))
    )
    share = F.try_divide(F.col("left_words").cast("double"), F.col("left_weights").cast("double")) * F.col("weight")
    return weighed.select("src", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, src, rank, words: the order of blocks; ``targets`` as of :func:`source_targets`, saved."""
    spark = targets.sparkSession
    total = targets.agg(F.sum(F.round("target")).cast("long")).first()[0] or 0
    slots = -(-total // block_words)
    below = Window.partitionBy(F.lit(0)).orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    wanted = targets.where("target > 0").withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("words") / block_words))
    spans = (
        wanted.withColumn("to", F.sum("target").over(below))
        .withColumn("all", F.sum("target").over(Window.partitionBy(F.lit(0))))
        .withColumn("last", F.max("src").over(Window.partitionBy(F.lit(0))))
        .select("src", "blocks", "words", ((F.col("to") - F.col("target")) / F.col("all")).alias("lo"), F.when(F.col("src") == F.col("last"), 2.0).otherwise(F.col("to") / F.col("all")).alias("hi"))
    )
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1).cast("long"))
    spans = saved(spans.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi")))), "spans")
    part = F.col("slot") % 1048576
    point = part * GOLDEN + F.floor(F.col("slot") / 1048576) * (1048576 * GOLDEN % 1)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = _join(points, spans, ["cell"]).where("u >= lo AND u < hi").select("slot", "src", "blocks", "words", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_chunk = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("k", in_chunk).join(counts.drop("count"), ["src", "chunk"]).withColumn("rank", F.col("k") + F.col("before"))
    reached = counts.groupBy("src").agg(F.sum("count").alias("n"))
    missing = (
        wanted.join(reached, "src", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < blocks")
        .select(F.lit(slots).cast("long").alias("slot"), "src", "words", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("rank"))
    )
    length = F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("rank") * block_words)
    return ranked.where("rank < blocks").select("slot", "src", "words", "rank").unionByName(missing).select("slot", "src", "rank", length.alias("words"))


def mix_words(docs: DataFrame, block_words: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and tie (checksum of the text), source."""
    text = whole_text()
    order = ["source", "h", "doc_id", "size", "tie", "nth"]
    rows = docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("tie"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("nth")
    rows = saved(rows, "mix-rows")
    targets = saved(source_targets(rows, passes), "mix-targets")
    blocks = schedule(targets, block_words).select("src", F.col("rank").alias("block"), "words")
    known = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    placed = _join(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), known.drop("source"), ["key"]).drop("key", "h")
    worded = placed.where("size > 0")
    sums = worded.groupBy("src", "part").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("src", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    laid = worded.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["src", "part"]).withColumn("start", F.col("base") + F.col("own"))
    cut = (
        laid.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
        .withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
        .where("pass = 0 OR from < target + 1")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words))))
    )
    overlap = F.least(F.col("from") + F.col("size"), F.col("block") * block_words + F.col("words")) - F.greatest(F.col("from"), F.col("block") * block_words)
    out = ["doc_id", "size", "source_size", "target", "taken", "tie", "source"]
    taken = (
        cut.join(blocks, ["src", "block"], "left")
        .groupBy("src", "start", "doc_id", "tie", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("words").isNotNull(), F.greatest(overlap, F.lit(0)))), F.lit(0)).cast("long").alias("taken"))
    )
    return taken.select(*out).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, to the nearest whole.

    Documents without words stay once: the mix has nothing to weigh in them.
    """
    words = mix_words(docs, block_words, passes)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1.0)).cast("int")
    # Equal rows share their number evenly, the first of them take what is over. All that has no words or is not taken stays out of the join.
    own = ["id", "source", "tie"]
    place = lambda *c: F.xxhash64(*c)
    numbers = words.withColumn("n", times).groupBy("doc_id", "source", "tie").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    row, at, mine, nth = unused(docs, "row", "at", "mine", "nth")
    numbers = numbers.select(place("doc_id", "source", "tie").alias(at), F.struct(F.col("doc_id").alias("id"), "source", "tie", "n", "rows").alias(row))
    tie = F.crc32(whole_text().cast("binary"))
    tied = docs.withColumn(mine, F.struct(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("source"), tie.alias("tie"))).withColumn(at, place(F.col("doc_id").cast("long"), "source", tie))
    joined = tied.join(numbers, at).where(" AND ".join(f"`{mine}`.{c} <=> `{row}`.{c}" for c in own))
    counted = joined.withColumn(nth, F.row_number().over(Window.partitionBy(at, *(F.col(f"`{mine}`.{c}") for c in own)).orderBy(F.lit(0))))
    repeat = F.floor(F.col(f"`{row}`.n") / F.col(f"`{row}`.rows")).cast("int") + F.when(F.col(nth) <= F.col(f"`{row}`.n") % F.col(f"`{row}`.rows"), 1).otherwise(0)
    return counted.withColumn(nth, F.explode(F.array_repeat(F.lit(0), repeat.cast("int")))).select(*docs.columns)


def mix_sql(block_words: int = BLOCK_WORDS, passes: int = PASSES) -> str:
    """DuckDB SQL of :func:`mix_words` over ``documents``: the words of a source's first ``round(target)``."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, src % 3 + 1 AS weight, source_size * {passes} AS cap FROM per),
r AS (SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (weights - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, total - coalesce(sum(cap) FILTER (ratio <= level) OVER (), 0) AS left_words, weights - coalesce(sum(weight) FILTER (ratio <= level) OVER (), 0) AS left_weights FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE left_words::DOUBLE / left_weights::DOUBLE * weight END AS target FROM f),
p AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS words,
    (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ({" + ".join(f"greatest(0, least(start + {k} * source_size + size, words) - (start + {k} * source_size))" for k in range(passes))})::BIGINT AS taken
FROM p"""
