from pyspark.sql import functions as F

from peptaflow.streaming.windows import read_events, tumbling, write_windows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 37 % 5, f"2024-01-01 0{i % 7}:{i % 60:02d}:00", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, u long, t string, value double").select("event_id", F.col("u").cast("string").alias("kind"), F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    total = F.sum("value").alias("v")
    stream = tumbling(read_events(spark, str(tmp_path / "in"), df.schema), "ts", "1 hour", "kind", total, late="1 hour")
    write_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in tumbling(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "kind", total).collect()}
    last = max(r[0] for r in want)
    assert {r for r in want if r[0] < last.replace(hour=last.hour - 1)} <= got <= want
