"""Per-batch metrics of rollouts as aggregates, and the long table they end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.text import _col
from rillflow.operators.rewards import GATES


def component(name: str) -> Column:
    """A reward component as a number; null and what is no number are 0 before any mean."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def conditional_mean(value: Column | str, where: Column) -> Column:
    return F.avg(F.when(where, F.coalesce(_col(value).try_cast("double"), F.lit(0.0))))


def rate(where: Column) -> Column:
    return F.try_divide(F.count_if(where), F.count(F.lit(1)))


def ratio_mean(success: Column | str, total: Column | str) -> Column:
    """Mean of ratios, a ratio being 0 without any call; not the ratio of sums."""
    return F.avg(F.coalesce(F.try_divide(_col(success), _col(total)), F.lit(0.0)))


BUILD = ("env_reward", "build_format_reward", "step1_format_reward", "schema_fn_reward", "schema_param_reward", "build_eval_reward", "judge_reward", "tool_call_count", "tool_success_call_count", "tool_error_call_count")
USE = ("env_reward", "build_format_reward", "step1_format_reward", "schema_fn_reward", "schema_param_reward", "tool_exec_raw", "tool_exec_norm", "tool_exec_scaled", "efficiency_multiplier", "final_answer_reward", "no_answer_penalty")


def batch_metrics(states: DataFrame) -> DataFrame:
    """(batch_id, name, value) of rollout states; a metric over an empty group has no row. One shuffle on the batch."""
    parts: dict[str, Column] = {"num_turns_mean": F.avg("num_turns"), "num_turns_min": F.min("num_turns").cast("double"), "num_turns_max": F.max("num_turns").cast("double")}
    for kind, names in (("build", BUILD), ("use", USE)):
        own = F.col("task_type") == kind
        for n in names:
            if n in states.columns:
                parts[f"rollout/{kind}/{n}"] = conditional_mean(n, own)
        if "step1_failure_reason" in states.columns:
            parts[f"rollout/{kind}/step1_failed_rate"] = F.try_divide(F.count_if(own & F.col("step1_failure_reason").isNotNull()), F.count_if(own))
            for reason in GATES:
                parts[f"rollout/{kind}/step1_fail_{reason}_rate"] = F.try_divide(F.count_if(own & F.col("step1_failure_reason").eqNullSafe(F.lit(reason))), F.count_if(own))
    if {"tool_success_call_count", "tool_call_count"} <= set(states.columns):
        parts["rollout/build/tool_success_call_rate"] = F.avg(F.when(F.col("task_type") == "build", F.coalesce(F.try_divide("tool_success_call_count", "tool_call_count"), F.lit(0.0))))
    if "final_answer_correct" in states.columns:
        parts["rollout/use/final_answer_correct_rate"] = conditional_mean(F.col("final_answer_correct").cast("int"), F.col("task_type") == "use")
    if "pool_used" in states.columns:
        parts["rollout/use/pool_coverage_rate"] = F.try_divide(F.count_if((F.col("task_type") == "use") & F.col("pool_used")), F.count_if(F.col("task_type") == "use"))
    wide = states.groupBy("batch_id").agg(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(parts.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("value")) for i, n in enumerate(parts)])
    return wide.select("batch_id", F.explode(pairs).alias("m")).select("batch_id", "m.name", "m.value").where("value IS NOT NULL")


def rollout_states(used: DataFrame, builds: DataFrame) -> DataFrame:
    """The rows of plans.rollout as states of batch_metrics: one row for each prompt, components by their published names.

    A use prompt whose category the pool does not cover has built instead; it counts as use, without the pool.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    zero = lambda *names: [F.lit(0.0).alias(n) for n in names]
    keys = ["batch_id", "prompt_index", "category"]
    own = used.select(
        *keys, F.lit("use").alias("task_type"), F.col("turns").cast("long").alias("num_turns"), F.lit(None).cast("string").alias("step1_failure_reason"), F.lit(True).alias("pool_used"), F.col("correct").cast("int").alias("final_answer_correct"),
        *[number(c) for c in ("env_reward", "tool_exec_raw", "tool_exec_norm", "efficiency_multiplier", "no_answer_penalty")], F.col("tool_exec_norm").alias("tool_exec_scaled"), F.col("use_correct_reward").cast("double").alias("final_answer_reward"),
        *zero("build_format_reward", "step1_format_reward", "schema_fn_reward", "schema_param_reward", "build_eval_reward", "judge_reward", "tool_call_count", "tool_success_call_count", "tool_error_call_count"),
    )
    passed = F.col("step1_failure_reason").isNull()
    made = builds.select(
        *keys, "task_type", F.lit(0).cast("long").alias("num_turns"), "step1_failure_reason", F.lit(False).alias("pool_used"), F.lit(0).alias("final_answer_correct"),
        number("env_reward"), *zero("tool_exec_raw", "tool_exec_norm", "efficiency_multiplier", "no_answer_penalty", "tool_exec_scaled", "final_answer_reward"),
        F.when(passed, F.col("build_format_reward") + F.col("schema_fn_reward") + F.col("schema_param_reward")).otherwise(0.0).alias("build_format_reward"), F.col("build_format_reward").alias("step1_format_reward"),
        *[number(c) for c in ("schema_fn_reward", "schema_param_reward", "build_eval_reward")], number("judge_reward") if "judge_reward" in builds.columns else F.lit(0.0).alias("judge_reward"),
        *[number(c) for c in ("tool_call_count", "tool_success_call_count", "tool_error_call_count")],
    )
    return own.unionByName(made)


def rollout_metrics(used: DataFrame, builds: DataFrame, pool: DataFrame) -> DataFrame:
    """(batch_id, name, value): every metric of the batches that plans.rollout returned, the pool's size after them included."""
    states = rollout_states(used, builds)
    size = states.select("batch_id").distinct().select("batch_id", F.lit("rollout/pool/total_tools").alias("name"), pool.agg(F.count("*").cast("double")).scalar().alias("value"))
    return batch_metrics(states).unionByName(by_category(states, by=["batch_id"])).unionByName(size)


def failure_rates(states: DataFrame) -> DataFrame:
    """Share of each failure reason within batch and task type; all reasons, those without a metric of their own too."""
    total = Window.partitionBy("batch_id", "task_type")
    per = states.groupBy("batch_id", "task_type", "step1_failure_reason").agg(F.count("*").alias("n"))
    return per.withColumn("rate", F.col("n") / F.sum("n").over(total)).where("step1_failure_reason IS NOT NULL")


def by_category(states: DataFrame, value: str = "env_reward", category: str = "category", by: list[str] | None = None) -> DataFrame:
    """Mean by category, named as a metric ('-' becomes '_')."""
    keys = by or []
    return states.groupBy(*keys, category).agg(F.avg(value).alias("value")).select(*keys, F.concat(F.lit("rollout/by_task/"), F.translate(F.col(category), "-", "_"), F.lit("/"), F.lit(value)).alias("name"), "value")


def build_scores(items: DataFrame) -> DataFrame:
    """Per build: score, items and tool counters from evaluated questions (build_id, ok_calls, bad_calls, answer, matched)."""
    correct = (F.col("ok_calls") > 0) & F.col("answer").isNotNull() & F.col("matched")
    return items.groupBy("build_id").agg(
        F.count_if(correct).alias("score"), F.count("*").alias("items"), F.sum(F.col("ok_calls") + F.col("bad_calls")).alias("made"), F.sum("ok_calls").alias("succeeded"), F.sum("bad_calls").alias("failed"),
        F.count_if(F.col("ok_calls") + F.col("bad_calls") > 0).alias("tool_called_items"), F.count_if(F.col("ok_calls") > 0).alias("tool_success_items"),
    ).withColumn("build_eval_reward", F.coalesce(F.try_divide("score", "items"), F.lit(0.0)))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """hit, total, accuracy and usage; errors count in the total; no rows give null, not an error."""
    return rows.groupBy(*by).agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("hit"), F.count("*").alias("total"), rate(F.coalesce("correct", F.lit(False))).alias("accuracy"), rate(F.coalesce("used_tools", F.lit(False))).alias("usage"))


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the group's spread."""
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + eps))


def metric_rollup(states: DataFrame, value: str = "env_reward") -> DataFrame:
    """Means over task type and category with all totals."""
    return states.rollup("task_type", "category").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
