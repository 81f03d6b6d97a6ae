"""Sharding by jump consistent hashing (operator 2), native.

The key's 64-bit linear congruential sequence decides the jumps; no ring table. With
one more shard a row stays or moves to the new shard. The law is ``key``: only
``doc_id`` and the number of shards decide, so copies of a text under other ids are
rows of their own.

Cases: a null id counts as 0; a null text has no bytes (size 8, crc of the empty
string); rows with equal ids share a shard and get slots of their own in order of
their text's checksum; an empty table makes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, whole_text

# Fixed value of the published algorithm: the generator's multiplier.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def jump_hash(key: Column, shards: int, grown: bool = True) -> Column:
    """Struct (shard, grown): the key's shard of ``shards``, and of one more.

    Spark has no wrapping product, so the state is two 32-bit halves and the
    multiplier three parts; all products stay below 2**63.
    """
    high, mid, low = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
    most = shards + 1 if grown else shards
    number = lambda n: F.lit(n).cast("long")

    def step(s: Column, _: Column) -> Column:
        lo, hi, j = s["lo"], s["hi"], s["j"]
        upper = lo * number(mid)
        first = lo * number(low) + 1 + F.shiftleft(upper.bitwiseAND(number(0xFFFF)), 16)
        carry = F.shiftright(first, 32) + F.shiftright(upper, 16)
        new_hi = (carry + lo * number(high) + hi * number(low) + F.shiftleft((hi * number(mid)).bitwiseAND(number(0xFFFF)), 16)).bitwiseAND(number(_LOW))
        to = F.floor((j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("long")
        went = F.struct(
            new_hi.alias("hi"),
            first.bitwiseAND(number(_LOW)).alias("lo"),
            to.alias("j"),
            F.when(j < shards, j).otherwise(s["shard"]).alias("shard"),
            j.alias("grown"),
        )
        return F.when(j < most, went).otherwise(s)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(number(_LOW)).alias("lo"), number(0).alias("j"), number(0).alias("shard"), number(0).alias("grown")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Narrow rows only are dealt out, by ranges of (doc_id, checksum), so that a key
    that many rows have is spread. Slots follow from each range's count per shard;
    no task sees a whole shard.
    """
    text = whole_text()
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", "text_crc32")
        .withColumn("to", jump_hash(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), shards))
        .select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"))
        .sortWithinPartitions("shard", "doc_id", "text_crc32")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int"))
    )
    rows = saved(rows, "shards")
    parts = rows.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(parts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"
    )


def shard_sql(shards: int = 24) -> str:
    """DuckDB SQL of :func:`shard_documents` over the view ``documents``."""
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT rid, doc_id, (length(h) // 2)::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, crc
), jump AS (
  SELECT rid, (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0) END)::HUGEINT AS key, 0::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT rid, x, j, floor((j + 1) * (2147483648.0::DOUBLE / ((x >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rid, j, (key * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT AS x FROM jump WHERE j < {shards + 1})
), placed AS (
  SELECT rid, max(b) FILTER (b < {shards}) AS shard, max(b) FILTER (b < {shards + 1}) AS grown_shard FROM jump GROUP BY rid
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM s JOIN placed USING (rid)"""
