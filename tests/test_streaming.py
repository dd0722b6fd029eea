from pyspark.sql import functions as F

from tracemill.streaming import steps


def test_transitions_across_batches(spark, tmp_path):
    schema = "user long, step long, state string, ts timestamp"
    rows = [[(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], [(1, 3, "c"), (2, 3, "y")]]
    for batch in rows:
        spark.createDataFrame(batch, "user long, step long, state string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = steps.transitions(source, "user", "step", "state").writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user"], r["step"]): r["previous"] for r in spark.table("steps").collect()}
    assert got == {(1, 1): "START", (1, 2): "a", (1, 3): "b", (2, 1): "START", (2, 3): "START"}


def test_windowed_counts_on_a_batch(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b")], "t string, k string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {(str(r["start"])[14:16], r["k"]): r["n"] for r in steps.windowed_counts(df, "ts", "k", "5 minutes", "1 minute").collect()}
    assert got == {("00", "a"): 2, ("05", "b"): 1}
