"""Windows and job state over streams give what they give over tables."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.streaming import windows as W

START = dt.datetime(2024, 1, 1)


def events(spark, folder):
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    x = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    x.coalesce(1).write.parquet(folder)
    return x


def run(frame, name, mode):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_tumbling_windows_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "e")
    table = events(spark, folder)
    stream = spark.readStream.schema(table.schema).parquet(folder)
    got = run(W.tumbling(stream, "1 hour", "10 minutes"), "tumbled", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.tumbling(table, "1 hour").collect()))
    assert W.sessions(table, "5 minutes").count() == 60 and W.sessions(table, "1 hour").count() == 3


def test_job_store_keeps_last_state(spark, tmp_path):
    folder = str(tmp_path / "e")
    table = events(spark, folder)
    stream = spark.readStream.schema(table.schema).parquet(folder).select(F.col("user_id").alias("job"), F.col("event_type").alias("state"), F.col("ts").alias("at")).withWatermark("at", "1 minute")
    rows = run(W.job_store(stream, 3600), "jobs", "update").where("status = 'live'").collect()
    assert {r.job: r.state for r in rows} == {0: "b", 1: "a", 2: "b"}
