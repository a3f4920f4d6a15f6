"""The tool pool and the event log as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.operators.pool import POOL_CAP

STATE = "seqs array<long>, qualities array<double>"
OUTPUT = "category string, seq long, quality double, kept long"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def pool_stream(events: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """Per micro-batch and category that it touches, the pool after its additions: (category, seq, quality, kept).

    events: (category, seq, quality). State is bounded by cap; the eviction rule is that of the batch operator.
    """
    cap = max(1, cap)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, qualities = (list(x) for x in state.get) if state.exists else ([], [])
        adds = pd.concat(list(batches)).sort_values("seq")
        for seq, quality in zip(adds["seq"], adds["quality"], strict=True):
            if len(seqs) >= cap:
                worst = min(range(len(seqs)), key=lambda i: (qualities[i], seqs[i]))
                del seqs[worst], qualities[worst]
            seqs.append(int(seq))
            qualities.append(float(quality))
        state.update((seqs, qualities))
        yield pd.DataFrame({"category": key[0], "seq": seqs, "quality": qualities, "kept": len(seqs)})

    return events.groupBy("category").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of JSON lines."""
    return spark.readStream.schema("ts timestamp, event string, rank int, world_size int, pid long, payload string").json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files of events."""
    return spark.readStream.schema(EVENT).parquet(path)


def windowed_rewards(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean value and count by event type and tumbling window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def write_pool(batch: DataFrame, path: str) -> None:
    """foreachBatch sink: each batch's pool rows, appended."""
    batch.write.mode("append").parquet(path)
