"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.sources import files
from tickloom.streaming import bars as stream

SCHEMA = "symbol string, us long, seq long, price double, volume long"


def ticks(spark):
    return spark.createDataFrame([(s, 1_600_000_000_000_000 + i * 61_000_000, i, 10.0 + (i * 7 % 5), i % 9) for s in "ab" for i in range(300)], SCHEMA)


def written(spark, tmp_path):
    for k in range(3):
        ticks(spark).where((F.col("seq") >= 100 * k) & (F.col("seq") < 100 * (k + 1))).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_threshold_bars(spark, tmp_path):
    got = run(stream.stream_threshold_bars(written(spark, tmp_path), "volume", 50), "volume_stream", tmp_path)
    want = bars.volume_bars(ticks(spark), ["symbol"], ["us", "seq"], 50)
    columns = ["symbol", "open", "high", "low", "close", F.col("volume").cast("double"), F.col("cum_buy_volume").cast("double"), "cum_ticks"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_time_bars_and_dedup(spark, tmp_path):
    source = written(spark, tmp_path)
    got = run(stream.stream_time_bars(source), "time_stream", tmp_path)
    want = bars.time_bars(ticks(spark), ["symbol"], ["us", "seq"], 3600).where("bar <= 1600014400")
    a = {(r["symbol"], int(r["date_time"].timestamp())): (r["open"], r["close"], r["cum_ticks"]) for r in got.withColumn("date_time", F.col("date_time")).collect()}
    b = {(r["symbol"], r["bar"]): (r["open"], r["close"], r["cum_ticks"]) for r in want.collect()}
    assert a and all(a[k] == b[k] for k in a.keys() & b.keys()) and len(a.keys() & b.keys()) >= 4
    again = run(stream.stream_dedup(source.union(source), ["symbol", "seq"]), "dedup_stream", tmp_path)
    assert again.count() == 600


def test_files(spark, tmp_path):
    df = ticks(spark).withColumn("date", F.to_date(F.timestamp_micros("us")))
    files.write_hive(df, str(tmp_path), "trades")
    back = files.scan_hive(spark, str(tmp_path), "trades", "a")
    assert back.count() == 300 and files.partitions(back).count() == 1
    assert files.date_range(back, "2020-09-13", "2020-09-13").count() == 300
    lines = spark.createDataFrame([('1600000000123000000||[{"ev":"T","sym":"A","p":1.5,"t":1600000000000},{"ev":"Q","sym":"A"}]',)], "value string")
    row = files.parse_capture(lines).first()
    assert (row["symbol"], row["price"], row["size"], row["delay_ms"]) == ("A", 1.5, 0, 123.0)
    files.write_as(df.select("us", "price", "volume"), f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 600


def test_sessions(spark, tmp_path):
    source = written(spark, tmp_path)
    got = run(stream.stream_session(source, "90 seconds", "10 seconds"), "session_stream", tmp_path)
    assert got.count() == 0  # ticks come every 61 seconds: the one open session waits
    got = run(stream.stream_session(source, "30 seconds", "10 seconds"), "short_stream", tmp_path).collect()
    assert len(got) > 500 and all(r["ticks"] == 1 and (r["end"] - r["start"]).total_seconds() == 30 for r in got)


def test_mad_and_smoother_equal_batch(spark, tmp_path):
    from tickloom.operators import adaptive, ingest

    got = {(r["symbol"], r["seq"]): r for r in run(stream.stream_mad_jma(written(spark, tmp_path), k=60.0), "mad_stream", tmp_path).collect()}
    want = ingest.mad_stream_status(ticks(spark), ["symbol"], ["us", "seq"], k=60.0)
    first = ticks(spark).where("seq = 0").first()["price"]
    for symbol in "ab":
        step = adaptive.jma_step(first, 7)
        for r in want.where(F.col("symbol") == symbol).orderBy("us", "seq").collect():
            now = got[symbol, r["seq"]]
            assert now["mad_status"] == r["mad_status"]
            smooth = step(r["price"]) if r["mad_status"] == "mad_clean" else None
            assert (smooth is None and now["jma"] is None) or abs(now["jma"] - smooth) < 1e-9
    assert len(got) == 600


def test_adaptive_bars_equal_batch_and_late_ticks_go_aside(spark, tmp_path):
    from tickloom.operators import adaptive

    limits = {"renko_size": 2.0, "volume_imbalance": 20, "max_seconds": 1800, "min_tick_count": 2}
    rows = ticks(spark).withColumn("status", F.when(F.col("seq") % 10 == 9, "mad_outlier").when(F.col("seq") % 4 == 3, "clean_pre_market").otherwise("clean_open_market"))
    for k in range(3):
        part = rows.where((F.col("seq") >= 100 * k) & (F.col("seq") < 100 * (k + 1))).withColumn("ts", F.timestamp_micros("us"))
        if k == 2:
            part = part.union(part.sparkSession.createDataFrame([("a", 1_600_000_000_000_001, 999, 1.0, 1, "clean_open_market")], "symbol string, us long, seq long, price double, volume long, status string").withColumn("ts", F.timestamp_micros("us")))
        part.drop("us").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/bars").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bars")
    got = run(stream.stream_bars(source, limits), "adaptive_stream", tmp_path)
    want = adaptive.bar_features(adaptive.adaptive_bars(rows, ["symbol"], limits), ["symbol"])
    key = lambda df: sorted((r["symbol"], r["bar"], r["open_at"], r["close_at"], round(r["jma_close"], 9), r["tick_count"], r["volume_imbalance"], r["bar_trigger"], round(r["price_wq50"], 9)) for r in df.collect())
    assert key(got.where("NOT late")) == key(want) and want.count() > 20
    late = got.where("late").collect()
    assert [(r["symbol"], r["bar"], r["open_at"], r["price_open"]) for r in late] == [("a", None, 1_600_000_000_000_001, 1.0)]


def test_capture_stream(spark, tmp_path):
    spark.createDataFrame([('1600000000123000000||[{"ev":"T","sym":"A","p":1.5,"t":1600000000000}]',), ("broken",)], "value string").coalesce(1).write.text(f"{tmp_path}/lines")
    got = run(files.stream_ingest(spark, f"{tmp_path}/lines"), "capture_stream", tmp_path).collect()
    assert [(r["symbol"], r["delay_ms"]) for r in got] == [("A", 123.0)]
    events = spark.createDataFrame([(1_600_000_000_123_000_000, 1_600_000_000_000)], "arrival_ns long, trade_ms long")
    assert files.latency(events).first()["delay_ms"] == 123.0


def test_interval_labels(spark, tmp_path):
    base = written(spark, tmp_path)
    shut = spark.createDataFrame([("a", 1_600_000_000_000_000 + 61_000_000 * 10)], "symbol string, us long").withColumn("close_at", F.timestamp_micros("us")).drop("us")
    shut.coalesce(1).write.parquet(f"{tmp_path}/closes")
    closes = spark.readStream.schema(shut.schema).parquet(f"{tmp_path}/closes")
    got = run(stream.stream_labels(closes, base, "3 seconds", "10 minutes"), "label_stream", tmp_path)
    assert got.count() == 9 and {r["symbol"] for r in got.collect()} == {"a"}


def test_matching_files(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, f"x{k}")], "a int, b string").coalesce(1).write.option("header", "true").csv(f"{tmp_path}/part{k}")
    assert sorted(map(tuple, files.read_matching(spark, f"{tmp_path}/part*").collect())) == [(0, "x0"), (1, "x1")]
    df = spark.createDataFrame([(1,)], "a int")
    files.append_csv(df, f"{tmp_path}/log")
    files.append_csv(df, f"{tmp_path}/log")
    assert files.read_matching(spark, f"{tmp_path}/log", schema="a int").count() == 2
