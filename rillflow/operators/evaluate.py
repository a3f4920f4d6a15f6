"""Tool-making evaluation: few-shot prompts, proposals scored on test questions, the best one run on the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import text, verify
from rillflow.operators import execute, metrics, rows

#: eval_equality of tasks that do not use plain equality of the extracted answer, and those that keep asterisks.
KEEP_STAR = ("bitwise_arithmetic", "countdown", "polynomial_equations", "polynomial_multiplication", "simple_equations", "simple_integration")


def eval_equality(task: str, said: str = "said", truth: str = "answer"):
    got = text.answer_offline(said, keep_star=task in KEEP_STAR)
    if task == "calendar_arithmetic":
        return verify.calendar_match(got, truth)
    if task == "tower_of_hanoi":
        return verify.hanoi_match(got, truth)
    if task == "cryptarithm":
        return verify.same_map(verify.parse_letter_dict(got), verify.parse_letter_dict(truth))
    return verify.exact(got, truth)


def few_shot_prompts(examples: DataFrame, by: str = "task") -> DataFrame:
    """(task, prompt): the reference part of each task as one block."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "question", "answer"))), lambda e: F.struct(e["question"].alias("question"), e["answer"].alias("answer")))
    return examples.where("part = 'reference'").groupBy(by).agg(text.few_shot_block(listed).alias("prompt"))


def score_proposals(proposals: DataFrame, tests: DataFrame, argument: str = "question") -> DataFrame:
    """(task, attempt, hit, total, accuracy, usage): each proposal's function is run on each test question of its task."""
    jobs = proposals.join(tests.select("task", "question", "answer"), "task").withColumn("args", F.to_json(F.struct(F.col("question").alias(argument)))).withColumn("timeout", F.lit(10))
    ran = execute.execute_jobs(jobs)
    ran = ran.withColumn("correct", (F.col("status") == "Success") & verify.answers_match("stdout", "answer")).withColumn("used_tools", F.col("status") == "Success")
    return metrics.accuracy(ran, "task", "attempt")


def tool_making(proposals: DataFrame, tests: DataFrame) -> DataFrame:
    """The best proposal of each task; ties keep the first attempt."""
    scored = score_proposals(proposals, tests)
    return rows.best_proposal(proposals.join(scored, ["task", "attempt"]), "task")


def baseline(dataset: DataFrame, replies: DataFrame, task: str) -> DataFrame:
    """Accuracy of replies without tools: (hit, total, accuracy, usage); no reply is wrong, and counted."""
    said = dataset.join(replies, "ordinal", "left").withColumn("correct", F.coalesce(eval_equality(task), F.lit(False))).withColumn("used_tools", F.lit(False))
    return metrics.accuracy(said)
