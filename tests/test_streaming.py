from pyspark.sql import functions as F

from rillflow.operators import pool
from rillflow.streaming import pool_stream


def test_stream_equals_batch(spark, tmp_path):
    adds = spark.range(60).select(F.concat(F.lit("c"), F.col("id") % 3).alias("category"), F.col("id").alias("seq"), (F.pmod(F.col("id") * 37, F.lit(23)) / 10).alias("quality"))
    source = str(tmp_path / "in")
    for k in range(3):
        adds.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(source)
    stream = pool_stream.pool_stream(spark.readStream.schema(adds.schema).option("maxFilesPerTrigger", 1).parquet(source), 5)
    states = []
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: states.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(states) >= 1
    want = {(r["category"], r["seq"]) for r in pool.pool_state(adds, 5).collect()}
    assert {(c, s) for c, s, *_ in states[-1]} == want


def test_windows(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "a", 1.0, "{}"), (2, "2024-01-01 00:50:00", 1, "a", 3.0, "{}"), (3, "2024-01-01 01:10:00", 1, "a", 5.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = pool_stream.windowed_rewards(pool_stream.event_stream(spark, str(tmp_path / "ev"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["mean"] for r in spark.table("windowed").collect()) == [2.0, 5.0]
