import datetime as dt

from pyspark.sql import functions as F

from lodestone.operators import stateful
from lodestone.session import shared_dir
from lodestone.streaming import stateful as streaming


def events(spark, path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, f"u{k % 2}", t0 + dt.timedelta(seconds=k // 3)) for k in range(24)]
    df = spark.createDataFrame(rows, "id long, u string, ts timestamp").withColumn("value", F.lit(1.0))
    df.coalesce(1).write.parquet(path)
    return df


def test_token_bucket_streams_like_it_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    df = events(spark, src)
    s = spark.readStream.schema(df.schema).parquet(src).withWatermark("ts", "1 hour")
    q = streaming.token_bucket(s, "u", "ts", "id", 2, 0.5).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["id"], r["allowed"]) for r in spark.table("bucket").collect()}
    assert got == {(r["id"], r["allowed"]) for r in stateful.token_bucket(df, ["u"], "ts", "id", 2, 0.5).collect()}


def test_windows_and_first_requests(spark, tmp_path):
    src = str(tmp_path / "in")
    df = events(spark, src)
    s = spark.readStream.schema(df.schema).parquet(src)
    q = streaming.windowed_counts(s, "ts", "u", "4 seconds", "1 second").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 12  # the last window is still open behind the watermark
    q = streaming.first_requests(s, ["u"], "ts", "1 hour").writeStream.format("memory").queryName("f").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("f").count() == 2


def test_incremental_files(spark, tmp_path):
    shared_dir(spark)
    batch = streaming.incremental_files(str(tmp_path / "index"))
    one = spark.createDataFrame([("a.py", b"1"), ("b.py", b"2"), ("a.py", b"1")], "file_path string, source_bytes binary")
    batch(one, 0)
    batch(one.unionByName(spark.createDataFrame([("a.py", b"9")], one.schema)), 1)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3
