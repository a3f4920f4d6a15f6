"""Tool sessions: creating a tool registers code under a short id, calling one runs a registered function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import pycode
from rillflow.operators import execute
from rillflow.operators.pool import evict_registry


def create_tools(requests: DataFrame) -> DataFrame:
    """Adds session_id (8 hex digits, null where it failed) and message to (seq, code, function_name).

    The id is a digest of seq, code and name, so a repeated task gives the same one.
    """
    rows = requests.withColumn("facts", pycode.py_facts("code"))
    named = F.array_contains(pycode.function_names("facts", with_async=True), F.col("function_name"))
    fine = F.col("facts")["ok"] & F.coalesce(named, F.lit(False))
    ident = F.left(F.sha2(F.concat_ws("\u0001", F.col("seq").cast("string"), "code", "function_name"), 256), F.lit(8))
    message = F.when(~F.col("facts")["ok"], F.concat(F.lit("Error: "), F.col("facts")["error"])).when(~fine, F.concat(F.lit("Error: no function "), "function_name")).otherwise(F.concat(F.lit("Tool created: "), ident))
    return rows.withColumn("session_id", F.when(fine, ident)).withColumn("message", message).drop("facts")


def register(registry: DataFrame | None, created: DataFrame, most: int = 10_000) -> DataFrame:
    """(seq, session_id, code, function_name) after adding what was created, cut to its newer half when too large."""
    new = created.where("session_id IS NOT NULL").select("seq", "session_id", "code", "function_name")
    return evict_registry(new if registry is None else registry.unionByName(new), most)


def call_tools(calls: DataFrame, registry: DataFrame, timeout: int = 10) -> DataFrame:
    """Adds tool_result to (call_id, session_id, args json): the output, '(no output)', or an error, also for an unknown id."""
    own = registry.select("session_id", "code", F.col("function_name").alias("function"))
    jobs = calls.join(own, "session_id", "left").withColumn("timeout", F.lit(timeout))
    known = execute.execute_jobs(jobs.where("code IS NOT NULL")).select(*calls.columns, "tool_result")
    unknown = jobs.where("code IS NULL").select(*calls.columns, F.concat(F.lit("Error: no tool "), F.coalesce("session_id", F.lit("null"))).alias("tool_result"))
    return known.unionByName(unknown)
