"""Rollouts over a stream of prompts: each micro-batch is a rollout batch, and the pool it builds is state of a second stream.

A micro-batch reads the pool as the batches before it left it, runs plans.rollout, and writes its use rows, builds, metrics and
admitted tools under its number, replacing what an earlier try of the same batch wrote. The tools then go through
pool_keeper, which ignores a batch that it has seen. So a query that is started again from its checkpoint, after a stop or a
lost driver, goes on as if it had never stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillflow.operators import metrics, pool
from rillflow.operators.execute import ModelClient
from rillflow.operators.pool import POOL_CAP
from rillflow.plans import rollout
from rillflow.streaming import pool_keeper

PROMPTS = "batch_id string, prompt_index long, prompt string"


def prompts_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files of prompts as a stream; a file is a batch by default."""
    return spark.readStream.schema(PROMPTS).option("maxFilesPerTrigger", files).parquet(path)


def additions_from(scored: DataFrame, number: int, cap: int) -> DataFrame:
    """What a batch's builds add to the pool, in order of batch and prompt."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(*rollout.PROMPT))
    rows = pool.admit(scored).select("category", F.lit(number).cast("long").alias("batch"), place.cast("long").alias("pos"), F.col("build_eval_reward").alias("quality"), "code", "tools")
    return rows.withColumn("cap", F.lit(cap))


def run_batch(prompts: DataFrame, number: int, client: ModelClient, folder: str, cap: int, **options: object) -> None:
    """One batch: rollout against the state's pool, its tables under batch=number, its tools into the state."""
    spark = prompts.sparkSession
    before = pool_keeper.pool_snapshot(spark, f"{folder}/keeper")
    used, scored, _ = rollout.rollout(prompts, before, client, f"{folder}/turns/batch={number}", **options)
    written = {}
    for name, rows in (("used", used), ("builds", scored)):
        rows.write.mode("overwrite").parquet(path := f"{folder}/{name}/batch={number}")
        written[name] = spark.read.schema(rows.schema).parquet(path)
    additions_from(written["builds"], number, cap).write.mode("overwrite").parquet(f"{folder}/additions/batch={number}")
    pool_keeper.keep_pool(pool_keeper.additions_of(spark, f"{folder}/additions"), f"{folder}/keeper", f"{folder}/changes", cap).awaitTermination()
    after = pool_keeper.pool_snapshot(spark, f"{folder}/keeper")
    metrics.rollout_metrics(written["used"], written["builds"], after).write.mode("overwrite").parquet(f"{folder}/metrics/batch={number}")


def rollout_stream(prompts: DataFrame, client: ModelClient, folder: str, cap: int = POOL_CAP, **options: object) -> StreamingQuery:
    """Starts the rollouts of all prompts there are; options are plans.rollout's. Tables lie under `folder`: used, builds, metrics,
    changes (pools that a batch touched), each by batch."""
    step = lambda batch, number: run_batch(batch, number, client, folder, cap, **options)
    return prompts.writeStream.option("checkpointLocation", f"{folder}/rollouts").foreachBatch(step).trigger(availableNow=True).start()
