"""Streamed bars equal batch bars for all windows that the watermark has closed."""

import datetime as dt

from pyspark.sql import functions as F

from seriesloom.streaming.live import live_bars, live_sentiment


def rows():
    start = dt.datetime(2024, 1, 1)
    return [("a", start + dt.timedelta(minutes=7 * i), float((i * 37) % 50) - 20) for i in range(100)]


def run(spark, tmp_path, name, make):
    folder = str(tmp_path / name)
    spark.createDataFrame(rows(), "k string, ts timestamp, v double").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(folder)
    query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_live_bars(spark, tmp_path):
    got = run(spark, tmp_path, "bars", lambda s: live_bars(s, ["k"], "ts", "v"))
    batch = spark.createDataFrame(rows(), "k string, ts timestamp, v double").groupBy("k", F.date_trunc("hour", "ts").alias("bin"))
    want = batch.agg(F.min_by("v", "ts").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "ts").alias("close"), F.count("*").alias("volume"))
    closed = {r.bin: tuple(r) for r in got.collect()}
    every = {r.bin: tuple(r) for r in want.collect()}
    assert len(closed) == len(every) - 1 and all(every[b] == r for b, r in closed.items())


def test_live_sentiment(spark, tmp_path):
    got = run(spark, tmp_path, "days", lambda s: live_sentiment(s, "ts", "v", late="1 minute"))
    assert got.count() == 0  # the only day is still open
