import datetime as dt

from pyspark.sql import functions as F

from quern.streaming.windows import sessions, windowed


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), k, 1.5) for i, (m, k) in enumerate([(0, "a"), (3, "a"), (12, "a"), (14, "b"), (60, "a"), (61, "b")])]
    return spark.createDataFrame(rows, "id long, ts timestamp, k string, v double")


def test_batch_windows(spark):
    got = {(r.start.minute + 60 * r.start.hour, r.k): (r.n, r.total) for r in windowed(events(spark), "ts", ["k"], "v", "10 minutes").collect()}
    assert got == {(0, "a"): (2, 3.0), (10, "a"): (1, 1.5), (10, "b"): (1, 1.5), (60, "a"): (1, 1.5), (60, "b"): (1, 1.5)}
    assert windowed(events(spark), "ts", [], "v", "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 12


def test_batch_sessions(spark):
    got = sorted((r.k, r.n) for r in sessions(events(spark), "ts", "k", "10 minutes").collect())
    assert got == [("a", 1), ("a", 3), ("b", 1), ("b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events(spark).schema).parquet(source)
    q = windowed(stream, "ts", ["k"], "v", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = windowed(events(spark), "ts", ["k"], "v", "10 minutes")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
