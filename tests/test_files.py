"""Files and folders, written and read back."""

import pytest
from pyspark.sql import functions as F

from tickloom.sources import files


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame([(s, f"2024-01-0{1 + i % 2}", i, 1.5 * i, i % 3) for s in ("A", "B") for i in range(20)], "symbol string, date string, us long, price double, volume long")


def same(a, b, columns):
    return sorted(map(tuple, a.select(*columns).collect())) == sorted(map(tuple, b.select(*columns).collect()))


def test_formats_and_layouts(spark, ticks, tmp_path):
    files.write_ticks(ticks.repartition(3), str(tmp_path), ("parquet", "csv", "json", "orc", "feather"))
    columns = ["symbol", "us", "price", "volume"]
    for kind in ("parquet", "orc", "json"):
        assert same(spark.read.format(kind).load(f"{tmp_path}/{kind}"), ticks, columns)
    assert same(spark.read.option("header", "true").schema("us long, price double, volume long, symbol string, date string").csv(f"{tmp_path}/csv"), ticks, columns)
    assert same(files.scan_feather(spark, f"{tmp_path}/feather/*.feather", "symbol string, us long, price double, volume long"), ticks, columns)
    assert len(list((tmp_path / "parquet").glob("symbol=*/date=*"))) == 4
    files.write_ticks(ticks, f"{tmp_path}/flat", ("parquet",), "file")
    assert not list((tmp_path / "flat" / "parquet").glob("symbol=*"))


def test_hive_pruning_projection_and_size(spark, ticks, tmp_path):
    files.write_hive(ticks.withColumn("date", F.to_date("date")), str(tmp_path), "trades")
    one = files.symbol_date(files.scan_hive(spark, str(tmp_path), "trades"), "A", "2024-01-02", ["us", "price"])
    assert one.columns == ["us", "price"] and one.count() == 10
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "ReadSchema: struct<us:bigint,price:double>" in plan
    files.write_hive(ticks.where("symbol = 'A' AND us < 4").withColumn("date", F.to_date("date")), str(tmp_path), "trades")  # overwrites A's dates only
    assert {(r["symbol"], r["n"]) for r in files.scan_hive(spark, str(tmp_path), "trades").groupBy("symbol").agg(F.count("us").alias("n")).collect()} == {("A", 4), ("B", 20)}
    sizes = files.storage_used(spark, f"{tmp_path}/trades").collect()
    assert len(sizes) == 4 and all(r["file_size"] > 0 for r in sizes)


def test_tick_csv_fails_on_broken_rows(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("date_time,price,volume\n2024-01-01 00:00:00.5,1.5,3\n2024-01-01 00:00:01,2,4\n")
    bad.write_text("date_time,price,volume\nyesterday,1.5,3\n")
    rows = files.scan_tick_csv(spark, str(good)).orderBy("date_time").collect()
    assert [(r["price"], r["volume"]) for r in rows] == [(1.5, 3.0), (2.0, 4.0)]
    with pytest.raises(Exception):
        files.scan_tick_csv(spark, str(bad)).collect()


def test_wide_csv_becomes_long(spark, tmp_path):
    for name, k in (("open", 1), ("close", 2)):
        (tmp_path / f"{name}.csv").write_text(f"date,X,Y\n2024-01-01,{k}.0,{k * 10}.0\n2024-01-02,{k + 1}.0,{k * 10 + 1}.0\n")
    rows = files.scan_wide_csv(spark, {n: f"{tmp_path}/{n}.csv" for n in ("open", "close")}).collect()
    assert {(str(r["date"]), r["sec"], r["open"], r["close"]) for r in rows} == {("2024-01-01", "X", 1.0, 2.0), ("2024-01-01", "Y", 10.0, 20.0), ("2024-01-02", "X", 2.0, 3.0), ("2024-01-02", "Y", 11.0, 21.0)}
