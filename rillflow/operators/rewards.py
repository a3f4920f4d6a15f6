"""Reward algebra of build and use rollouts: plain columns in, plain columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import ANSWER_TAG, _col, answer_tag_count

#: Fixed values of the reward design.
EXEC_OK, EXEC_FAILED = 0.3, -0.2
GATE_BONUS = 0.5
NO_ANSWER = -0.5
WRONG_ATTEMPT = 0.1
MAX_ITERS = 5
GATES = ("missing_python_or_schema", "schema_missing_function_name", "schema_function_mismatch", "schema_param_mismatch", "invalid_tool_schema", "xgrammar_incompatible_schema")


def exec_delta(ok: Column | str) -> Column:
    return F.when(_col(ok), EXEC_OK).otherwise(EXEC_FAILED)


def exec_norm(raw: Column | str, max_iters: int = MAX_ITERS) -> Column:
    """At most 1; there is no lower bound."""
    return F.least(_col(raw) / (EXEC_OK * max_iters), F.lit(1.0))


def efficiency(turns: Column | str, max_iters: int = MAX_ITERS) -> Column:
    """Falls gently for the first half of the turns and quadratically after."""
    r = F.least(_col(turns) / F.lit(float(max_iters)), F.lit(1.0))
    rest = 1 - 2 * (r - 0.5)
    return F.when(r <= 0.5, 1 - 0.6 * r).otherwise(0.7 * rest * rest)


def correct_reward(correct: Column | str, turns: Column | str, max_iters: int = MAX_ITERS) -> Column:
    return 2.0 * _col(correct).cast("int") * efficiency(turns, max_iters)


def use_env_reward(raw: Column | str, answer: Column | str, max_iters: int = MAX_ITERS) -> Column:
    """Normed execution reward, and a penalty where the answer is null ('' is an answer)."""
    return exec_norm(raw, max_iters) + F.when(_col(answer).isNull(), NO_ANSWER).otherwise(0.0)


def use_rewards(df: DataFrame, max_iters: int = MAX_ITERS) -> DataFrame:
    """Adds the use columns to rows of (correct, turns, tool_exec_raw, answer)."""
    return df.withColumns({
        "tool_exec_norm": exec_norm("tool_exec_raw", max_iters), "efficiency_multiplier": efficiency("turns", max_iters), "use_correct_reward": correct_reward("correct", "turns", max_iters),
        "no_answer_penalty": F.when(F.col("answer").isNull(), NO_ANSWER).otherwise(0.0), "final_attempt_reward": F.when(F.col("answer").isNotNull() & ~F.col("correct").cast("boolean"), WRONG_ATTEMPT).otherwise(0.0), "env_reward": use_env_reward("tool_exec_raw", "answer", max_iters),
    })


def gate_reason(has_both: Column, has_name: Column, name_found: Column, params_ok: Column, schema_ok: Column, compat_ok: Column) -> Column:
    """The first gate that fails, or null."""
    out = None
    for ok, reason in zip((has_both, has_name, name_found, params_ok, schema_ok, compat_ok), GATES, strict=True):
        out = (F if out is None else out).when(~F.coalesce(ok, F.lit(False)), F.lit(reason))
    return out


def gate_rewards(reason: Column | str, format_ok: Column | str) -> Column:
    """struct of the step-1 rewards; a failing gate leaves env_reward 0, the format bonus is no gate."""
    r = _col(reason)
    level = F.coalesce(*[F.when(r == g, F.lit(i)) for i, g in enumerate(GATES)], F.lit(len(GATES)))
    fmt = F.when(_col(format_ok), GATE_BONUS).otherwise(0.0)
    name, params = F.when(level > 2, GATE_BONUS).otherwise(0.0), F.when(level > 3, GATE_BONUS).otherwise(0.0)
    return F.struct(fmt.alias("build_format_reward"), name.alias("schema_fn_reward"), params.alias("schema_param_reward"), F.when(r.isNull(), fmt + name + params).otherwise(0.0).alias("env_reward"), r.isNotNull().alias("done"))


def build_total(env: Column | str, score: Column | str, items: Column | str) -> Column:
    return _col(env) + F.coalesce(F.try_divide(_col(score), _col(items)), F.lit(0.0))


def spam_penalty(text: Column | str, most: float = 2.0, per: float = 0.5) -> Column:
    return spam_penalty_of(answer_tag_count(text), most, per)


def spam_penalty_of(count: Column | str, most: float = 2.0, per: float = 0.5) -> Column:
    n = _col(count)
    return F.when(n <= 1, 0.0).otherwise(-F.least(F.lit(most), per * (n - 1)))


def format_reward(text: Column | str) -> Column:
    t = _col(text)
    return F.when(F.regexp_like(t, F.lit(ANSWER_TAG)) | F.contains(t, F.lit("\\boxed{")), 0.5).otherwise(0.0)


def tool_usage_reward(names: Column | str) -> Column:
    n = _col(names)
    made, called = F.array_contains(n, "create_tool"), F.array_contains(n, "call_tool")
    return F.when(made & called, 1.0).when(made, 0.3).otherwise(0.0)


def passthrough(value: Column | str) -> Column:
    return F.coalesce(_col(value).try_cast("double"), F.lit(0.0))


def renorm(step1: Column | str, step2: Column | str, reward: Column | str, w1: float = 0.5, w2: float = 0.5) -> Column:
    """In [-1, 1]."""
    return w1 * _col(step1) + w2 * _col(step2) + F.when(_col(reward) > 0, 1.0).otherwise(0.0) - 1.0


def capped_penalty(amount: Column | str, cap: float = 2.0) -> Column:
    return 0.0 - F.least(F.lit(cap), _col(amount))  # never a negative zero


def correctness_reward(shifted: Column, truth: Column, answer: Column, matched: Column, judged: Column) -> Column:
    """0 for a shifted context, no truth or no answer; 2 for a match; 1 for a judge's yes."""
    none = shifted | F.coalesce(truth == "", F.lit(True)) | F.coalesce(answer == "", F.lit(True))
    return F.when(none, 0.0).when(matched, 2.0).when(F.coalesce(judged, F.lit(False)), 1.0).otherwise(0.0)


def step1_score(parses: Column, runs: Column) -> Column:
    return F.when(~F.coalesce(parses, F.lit(False)), 0.0).when(runs, 1.0).otherwise(0.5)


def step2_score(call_json_ok: Column, schema_json_ok: Column) -> Column:
    return F.when(call_json_ok, 0.5).otherwise(0.0) + F.when(call_json_ok & schema_json_ok, 0.5).otherwise(0.0)


def align_index(position: Column, n: Column, m: Column) -> Column:
    """Which of m answers (from 0) goes with completion `position` of n; null stands for a blank.

    Equal counts pair off; where m divides n each answer repeats n/m times; more answers are cut; else the last one pads.
    """
    return F.when(m == 0, F.lit(None).cast("int")).when((n % m) == 0, F.floor(position / (n / m))).otherwise(F.least(position, m - 1)).cast("int")
