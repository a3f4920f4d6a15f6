"""All rewards of a batch of completions, from messages to one row of columns each.

Completions are rows (rollout_id, question, answer, messages, ...). What can be settled by rules is settled on columns; only
answers that the rules leave open go to the judge, and only code that parses is run. Joins are on rollout_id, which must
be unique; it may not be null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import pycode, text, verify
from rillflow.operators import execute, payloads, rewards
from rillflow.operators.execute import ModelClient
from rillflow.operators.scoring import EQUIVALENCE
from rillflow.sources.replay import batch_folder

#: Rewards that a rollout hands on as they are, by the column that they come from.
PASSED_ON = {"env_reward": "env_reward", "use_correct_reward": "use_correct_reward", "judge_reward": "judge_reward"}


def aligned(completions: DataFrame, truths: DataFrame, batch: str = "batch_id", position: str = "position") -> DataFrame:
    """completions with the question and answer of their batch that stands at their place among truths (batch, position, question,
    answer), by the rule of rewards.align_index; null where a batch has none. Positions count from 0."""
    n = completions.groupBy(F.col(batch).alias("_b")).agg(F.count("*").alias("_n"))
    m = truths.groupBy(F.col(batch).alias("_b")).agg(F.count("*").alias("_m"))
    rows = completions.join(n, F.col(batch) == F.col("_b")).drop("_b").join(m, F.col(batch) == F.col("_b"), "left").drop("_b")
    rows = rows.withColumn("_at", rewards.align_index(F.col(position), F.col("_n"), F.coalesce("_m", F.lit(0))))
    place = truths.select(F.col(batch).alias("_b"), F.col(position).alias("_p"), "question", "answer")
    return rows.join(place, (F.col(batch) == F.col("_b")) & (F.col("_at") == F.col("_p")), "left").drop("_b", "_p", "_n", "_m", "_at")


def said(messages: Column | str) -> Column:
    """What a completion says in the end: its text after the last tool response."""
    return F.substring_index(text.unwrap_completion(messages), text.TOOL_RESPONSE_END, -1)


def correctness(completions: DataFrame, judge: ModelClient | None = None, folder: str | None = None) -> DataFrame:
    """(rollout_id, final, correctness_reward): 0 for a shifted context, no truth or no answer; 2 for an answer that a rule
    confirms (equality, a solved word sum, the same knights and knaves); 1 where the judge says yes; else 0. What the judge
    says is written to `folder` (by default one in the session's shared folder), so that no later step asks it again."""
    rows = completions.select("rollout_id", "question", "answer", said("messages").alias("said")).join(payloads.shifted(completions), "rollout_id")
    rows = rows.withColumn("final", text.answer_rewards("said"))
    settled = F.col("shifted") | (verify.normalize_answer("answer") == "") | (F.coalesce("final", F.lit("")) == "")
    matched = verify.answers_match("final", "answer") | verify.cryptarithm_solved("question", "final") | verify.knights_match("final", "answer")
    rows = rows.withColumn("rule", F.when(settled, 0.0).when(F.coalesce(matched, F.lit(False)), 2.0))
    known = rows.where("rule IS NOT NULL").select("rollout_id", "final", F.col("rule").alias("correctness_reward"))
    open_ = rows.where("rule IS NULL")
    if judge is None:
        return known.unionByName(open_.select("rollout_id", "final", F.lit(0.0).alias("correctness_reward")))
    asked = open_.select("rollout_id", "final", F.format_string(EQUIVALENCE, "final", "answer").alias("prompt"), F.lit(0).alias("turn"))
    path = f"{folder or batch_folder(completions.sparkSession)}/judged-{uuid.uuid4().hex}"
    judge.generate(asked).select("rollout_id", "final", "reply").write.parquet(path)
    told = completions.sparkSession.read.parquet(path)
    return known.unionByName(told.select("rollout_id", "final", F.when(verify.yes_no("reply"), 1.0).otherwise(0.0).alias("correctness_reward")))


def step1_scores(completions: DataFrame, timeout: float = 10.0, sandbox: str | None = None) -> DataFrame:
    """(rollout_id, score): 0 without code that parses, 1 where the last code a completion gives runs, 0.5 where it fails."""
    code = payloads.created_code(completions).withColumn("parses", pycode.py_facts("code")["ok"] & F.col("code").isNotNull())
    jobs = code.where("parses").select("rollout_id", "code", F.lit(None).cast("string").alias("function"), F.lit("{}").alias("args"), F.lit(timeout).alias("timeout"))
    ran = execute.execute_jobs(jobs, sandbox=sandbox).select("rollout_id", rewards.step1_score(F.lit(True), F.col("status") == "Success").alias("score"))
    return ran.unionByName(code.where(~F.coalesce("parses", F.lit(False))).select("rollout_id", F.lit(0.0).alias("score")))


def reward_table(completions: DataFrame, judge: ModelClient | None = None, timeout: float = 10.0, sandbox: str | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(rollout_id, and every reward): one row for each completion. Rewards of PASSED_ON are 0 where the completions lack them."""
    own = completions.select(
        "rollout_id", rewards.format_reward(text.unwrap_completion("messages")).alias("format_reward"), rewards.spam_penalty(text.unwrap_completion("messages")).alias("final_answer_spam_penalty"),
        *[(rewards.passthrough(source) if source in completions.columns else F.lit(0.0)).alias(name) for name, source in PASSED_ON.items()],
    )
    used = payloads.tool_names(completions).select("rollout_id", rewards.tool_usage_reward("names").alias("tool_usage_reward"))
    fined = payloads.penalties(completions).select("rollout_id", F.col("python_penalty").alias("tool_python_syntax_penalty"), F.col("json_penalty").alias("tool_json_schema_penalty"), F.col("both_penalty").alias("tool_syntax_schema_penalty"))
    step1, step2 = step1_scores(completions, timeout, sandbox).withColumnRenamed("score", "step1"), payloads.step2_scores(completions).withColumnRenamed("score", "step2")
    rows = own
    for part in (correctness(completions, judge).select("rollout_id", "correctness_reward"), used, fined, step1, step2):
        rows = rows.join(part, "rollout_id")
    return rows.withColumn("process_renorm_reward", rewards.renorm("step1", "step2", "correctness_reward", *weights))


def group_rewards(table: DataFrame, weights: dict[str, float], group: str = "batch_id") -> DataFrame:
    """table (group, rewards) with total, the weighted sum, and advantage, the total less its group's mean over the group's spread."""
    total = sum((F.lit(float(w)) * F.col(name) for name, w in weights.items()), F.lit(0.0))
    own = Window.partitionBy(group)
    rows = table.withColumn("total", total)
    return rows.withColumn("advantage", (F.col("total") - F.avg("total").over(own)) / (F.stddev_pop("total").over(own) + 1e-6))
