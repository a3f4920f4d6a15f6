"""Stages that score what a batch has built and answered: test questions, the quality judge, the equivalence judge.

Model calls go through a ModelClient; who is asked is decided on columns before, so no call is made for rows whose score
is known. A reply that is missing or does not parse counts as the least score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import jsonx, pycode, text, verify
from rillflow.operators.execute import ModelClient

#: Items that a colocated evaluation has at least, and the share of the model's length that a prompt may take.
LEAST_ITEMS = 5
PROMPT_SHARE = 0.8
SYNTAX_PENALTY = -0.5
EQUIVALENCE = "Are these two expressions equal? Answer yes or no.\n\nExpression 1: %s\nExpression 2: %s"


def fits(prompt: Column | str, count_tokens: Callable[[Column], Column] | None, max_model_len: int | None) -> Column:
    """Whether a prompt leaves the model room to answer; always, where the length or the tokenizer is not known."""
    if count_tokens is None or max_model_len is None:
        return F.lit(True)
    return count_tokens(F.col(prompt) if isinstance(prompt, str) else prompt) <= max_model_len * PROMPT_SHARE


def build_questions(builds: DataFrame, tests: Column | str, keys: list[str], most: int | None = None, least: int = 1) -> DataFrame:
    """A row per build and test question: keys, item, prompt, target_answer, code, tools. Where a build has fewer questions
    than `least`, all of them are asked again until it has as many; `most` keeps the first so many."""
    asked = F.col(tests) if isinstance(tests, str) else tests
    asked = F.slice(asked, 1, most) if most else asked
    n = F.size(asked)
    times = F.when(n > 0, F.ceil(F.lit(float(least)) / n)).cast("int")
    again = F.flatten(F.array_repeat(asked, F.greatest(times, F.lit(1))))
    rows = builds.select(*keys, "code", "tools", F.posexplode(again).alias("item", "t"))
    return rows.select(*keys, "item", F.col("t")["question"].alias("prompt"), F.col("t")["answer"].alias("target_answer"), "code", "tools")


def build_evaluation(answered: DataFrame, keys: list[str], partial: float = 0.0, colocated: bool = False) -> DataFrame:
    """Per build: score, build_eval_reward and the tool counters, from answered questions (run_use's columns).

    An answer that matches counts 1 if a tool call of its own succeeded. Colocated evaluation gives `partial` to any other
    answer; the external one gives it nothing.
    """
    worked, given = F.col("tool_ok") > 0, F.col("answer").isNotNull()
    won = worked & (F.col("correct") == 1)
    points = F.when(won, 1.0).when(given, partial if colocated else 0.0).otherwise(0.0)
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return answered.groupBy(*keys).agg(
        F.sum(points).alias("score"), F.count("*").alias("total_items"), (F.sum(points) / F.count("*")).alias("build_eval_reward"),
        F.sum("turns").cast("long").alias("tool_call_count"), F.sum("tool_ok").cast("long").alias("tool_success_call_count"), (F.sum("turns") - F.sum("tool_ok")).cast("long").alias("tool_error_call_count"),
        count(F.col("turns") > 0).alias("tool_called_items"), count(worked if colocated else won).alias("tool_success_items"), count(F.col("too_long")).alias("too_long_prompt_count"),
    )


def judge_route(facts: Column | str, tools: Column | str) -> Column:
    """struct(fixed, weight): the score that needs no judge (null if it is to be asked), and what a judge's score counts.

    Code that does not parse and a schema whose function is not in the code are settled; any other mismatch halves.
    """
    reason = pycode.alignment(facts, tools)
    fixed = F.when(reason == "syntax_error", SYNTAX_PENALTY).when(reason == "function_not_found", 0.0)
    return F.struct(fixed.alias("fixed"), F.when(reason.isNull(), 1.0).otherwise(0.5).alias("weight"))


def judge_builds(builds: DataFrame, client: ModelClient, questions: Column | str, most: int = 3) -> DataFrame:
    """builds (code, schema, tools ...) with judge_reward: between 0 and 1, or less for code that does not parse."""
    asked = F.transform(F.slice(F.col(questions) if isinstance(questions, str) else questions, 1, most), lambda q: q["question"])
    rows = builds.withColumn("_route", judge_route(pycode.py_facts("code"), "tools"))
    known = rows.where("_route.fixed IS NOT NULL").withColumn("judge_reward", F.col("_route.fixed"))
    prompts = rows.where("_route.fixed IS NULL").withColumns({"_own": F.struct(*[F.col(c) for c in builds.columns]), "prompt": text.judge_prompt(asked, F.coalesce("code", F.lit("")), F.coalesce("schema", F.lit(""))), "turn": F.lit(0)})
    said = client.generate(prompts.select("_own", "_route", "prompt", "turn"))
    judged = said.select("_own.*", (jsonx.overall_quality(jsonx.judge_scores("reply")) * F.col("_route.weight")).alias("judge_reward"))
    return known.drop("_route").unionByName(judged)


def judge_answers(use: DataFrame, client: ModelClient) -> DataFrame:
    """use rows (answer, target_answer, correct ...) with `correct` set where a judge says yes to answers that do not match.

    Only rows with an answer and a target that failed to match are asked.
    """
    open_ = (F.col("correct") == 0) & (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("target_answer", F.lit("")) != "")
    ask = F.coalesce(open_, F.lit(False))
    prompts = use.where(ask).select(F.struct(*[F.col(c) for c in use.columns]).alias("_own"), F.format_string(EQUIVALENCE, "answer", "target_answer").alias("prompt"), F.lit(0).alias("turn"))
    said = client.generate(prompts).select("_own.*", verify.yes_no("reply").cast("int").alias("_yes"))
    return use.where(~ask).unionByName(said.withColumn("correct", F.col("_yes")).select(*use.columns))
