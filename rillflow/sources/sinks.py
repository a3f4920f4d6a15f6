"""Logs and artefacts of rollouts as append-only tables."""

from __future__ import annotations

import logging
import os

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
#: The columns of the two debug tables.
USE_COLUMNS = ("prompt_index", "pool_used", "target_answer", "answer", "correct", "tool_exec_raw", "turns", "efficiency_multiplier", "use_correct_reward", "tool_exec_norm", "final_attempt_reward", "env_reward")
JUDGE_COLUMNS = ("timestamp", "model", "status", "code_correctness", "code_clarity", "schema_quality", "schema_code_alignment", "overall_quality_score", "aligned", "time_s", "error")


def write_event_log(df: DataFrame, path: str, event: str, payload: dict[str, Column], world_size: int = 1) -> bool:
    """JSON lines of ts, event, rank, world_size, pid and the payload's own fields; whether they were written.

    No path, no log; and a log that cannot be written stops nothing.
    """
    if not path:
        return False
    head = {"ts": F.current_timestamp(), "event": F.lit(event), "rank": F.spark_partition_id(), "world_size": F.lit(world_size), "pid": F.lit(os.getpid()).cast("long")}
    try:
        df.select(*[c.alias(n) for n, c in {**head, **payload}.items()]).write.mode("append").json(path)
    except (PySparkException, Py4JError, OSError) as e:
        LOG.warning("event log %s: %s", path, e)
        return False
    return True


def evaluation_entries(log: DataFrame) -> DataFrame:
    """(stats, messages, round_usage) of conversations that were evaluated; round_usage is keyed by the round."""
    stats = ["question", F.col("target").alias("ground_truth"), "total_rounds", "total_prompt_tokens", "total_completion_tokens", "tool_calls_made", "tool_calls_successful", "tool_calls_failed", F.col("final_answer_text").alias("final_answer_extracted"), "correct", "used_tools", "conversation_length", "tool_names_used"]
    usage = F.transform("round_usage", lambda u: F.struct(u["round"].cast("string"), F.struct(u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"), u["tool_used"].alias("tool_used"))))
    return log.select(F.struct(*stats).alias("stats"), "messages", F.map_from_entries(usage).alias("round_usage"))


def write_evaluation_log(log: DataFrame, path: str) -> None:
    """One JSON object a line; the baseline's log is the same at another path."""
    evaluation_entries(log).write.mode("append").json(path)


def debug_table(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows as markdown lines, for a text sink."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\n|]", " "), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_debug_table(df: DataFrame, path: str, columns: tuple[str, ...] | list[str]) -> None:
    """Appends rows to a folder of markdown; the header is written once, as a file that sorts before all others."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/000-header.md")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        out = files.create(at)
        out.write(f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n".encode())
        out.close()
    debug_table(df, columns).write.mode("append").text(path)


def rollout_prints(df: DataFrame, header: str, on: bool) -> DataFrame:
    """(line) what a rollout's messages look like in a console, none where printing is off."""
    title = F.concat(F.lit(f"===== {header} | task="), F.coalesce("task_type", F.lit("unknown")), F.lit(" | prompt_index="), F.coalesce(F.col("prompt_index").cast("string"), F.lit("-1")), F.lit(" ====="))
    code = F.when(F.coalesce("code", F.lit("")) != "", F.concat(F.lit("\n----- TOOL PYTHON CODE -----\n"), "code", F.lit("\n----- END TOOL PYTHON CODE -----"))).otherwise(F.lit(""))
    said = F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("unknown")), F.lit(":\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")
    return df.where(F.lit(on) & (F.size("messages") > 0)).select(F.concat(title, code, F.lit("\n"), said, F.lit("\n===== END ROLLOUT MESSAGES =====")).alias("line"))


def write_artifacts(proposals: DataFrame, path: str) -> None:
    """Code and schema of each proposal, partitioned by task."""
    proposals.select("task", "attempt", "code", "schema").write.mode("append").partitionBy("task").parquet(path)


def read_artifacts(spark, path: str, task: str | None = None) -> DataFrame:
    """(task, attempt, code, schema) of what write_artifacts has written."""
    found = spark.read.schema("attempt int, code string, schema string, task string").parquet(path)
    return found.where(F.col("task") == task) if task else found
