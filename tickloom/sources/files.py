"""Hive-partitioned tables, tick CSVs, captured stream lines and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Three columns, as the batch bars expect them.
TICK_CSV = T.StructType([T.StructField("date_time", T.TimestampNTZType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
#: Events of a captured message.
EVENT = "array<struct<ev: string, sym: string, x: int, i: string, z: int, p: double, s: bigint, c: array<int>, t: bigint>>"


def scan_hive(spark: SparkSession, root: str, kind: str, symbol: str | None = None) -> DataFrame:
    """A table of ``root/kind/symbol=S/date=D``; unreadable files are skipped, partitions pruned by filters."""
    df = spark.read.option("basePath", f"{root}/{kind}").option("ignoreCorruptFiles", "true").parquet(f"{root}/{kind}")
    return df.where(F.col("symbol") == symbol) if symbol else df


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of dates from ``start`` to ``end``, both in; reaches the scan as a partition filter."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def symbol_date(df: DataFrame, symbol: str, date: str, columns: list[str] | None = None) -> DataFrame:
    df = df.where((F.col("symbol") == symbol) & (F.col("date") == F.lit(date).cast("date")))
    return df.select(*columns) if columns else df


def partitions(df: DataFrame) -> DataFrame:
    """(symbol, date) values."""
    return df.select("symbol", "date").distinct()


def write_hive(df: DataFrame, root: str, kind: str) -> None:
    """Writes (symbol, date) partitions; only those present are overwritten."""
    df.repartition("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").parquet(f"{root}/{kind}")


def write_as(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """csv or parquet (or another writer's format), flat or partitioned."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def storage_used(spark: SparkSession, path: str) -> DataFrame:
    """Bytes per file, from file metadata."""
    return spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()


def scan_tick_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """date_time, price, volume; a row that does not fit fails the read."""
    return spark.read.schema(TICK_CSV).option("header", "true").option("mode", "FAILFAST").csv(paths)


def scan_wide_csv(spark: SparkSession, paths: dict[str, str], time: str = "date") -> DataFrame:
    """Wide CSVs (one column a security) as one long table (time, sec, one column a path)."""
    out = None
    for name, path in paths.items():
        wide = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
        long = wide.unpivot([time], [c for c in wide.columns if c != time], "sec", name)
        out = long if out is None else out.join(long, [time, "sec"])
    return out


def parse_capture(lines: DataFrame) -> DataFrame:
    """Trades of captured lines ``arrival_ns||[events]``: renamed, with the delay from trade to arrival in ms; other lines make no row."""
    parts = F.split("value", r"\|\|", 2)
    events = lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("arrival_ns"), F.explode(F.from_json(F.get(parts, F.lit(1)), EVENT)).alias("e")).where("e.ev = 'T'")
    return events.select(
        F.col("e.sym").alias("symbol"), F.col("e.p").alias("price"), F.coalesce("e.s", F.lit(0).cast("long")).alias("size"), F.col("e.x").alias("exchange_id"), F.col("e.i").alias("trade_id"), F.col("e.c").alias("conditions"),
        F.col("e.t").alias("trade_ms"), "arrival_ns", (F.col("arrival_ns") / 1_000_000 - F.col("e.t")).alias("delay_ms"),
    )


def read_matching(spark: SparkSession, pattern: str, kind: str = "csv", schema: str | None = None) -> DataFrame:
    """All files that a glob matches, as one table; columns by name, those that some files lack null."""
    reader = spark.read.option("mergeSchema", "true")
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    return (reader.schema(schema) if schema else reader).format(kind).load(pattern)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each with its header; readers see one table."""
    df.write.mode("append").option("header", "true").csv(path)


def latency(events: DataFrame) -> DataFrame:
    """``delay_ms``: arrival less trade time, for rows with ``arrival_ns`` and ``trade_ms``."""
    return events.withColumn("delay_ms", F.col("arrival_ns") / 1_000_000 - F.col("trade_ms"))


def stream_ingest(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Trades of captured lines, as a stream over a folder of capture files; a line that does not parse makes no row."""
    return parse_capture(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path))


def write_feather(df: DataFrame, folder: str) -> DataFrame:
    """One Arrow file a partition (written under a new name, so a repeated task leaves the other whole); returns (path, rows) of those reported.

    ``folder`` is any place that all executors reach.
    """
    from ..session import reachable

    columns = df.columns

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        path, writer, rows = f"{base}/part-{uuid.uuid4().hex}.feather", None, 0
        for batch in batches:
            batch = batch.rename_columns(columns)
            if writer is None:
                sink = system.open_output_stream(path)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "rows": [rows]})

    reachable(df.sparkSession)
    return df.mapInArrow(write, "path string, rows long")


def scan_feather(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of Arrow files, each file one task's work; columns by name."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(T._parse_datatype_string(schema))

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                for part in pa.ipc.open_file(content.as_buffer()).read_all().select(want.names).cast(want).to_batches():
                    yield part

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(read, schema)


def write_ticks(df: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "feather"), layout: str = "hive") -> None:
    """The same ticks in several formats: flat, or by (symbol, date) folders (``hive``); Arrow files are always flat."""
    for kind in formats:
        if kind == "feather":
            write_feather(df, f"{folder}/feather").collect()  # one row a partition
        else:
            write_as(df, f"{folder}/{kind}", kind, ["symbol", "date"] if layout == "hive" else None)
