"""Deadlines of scores: what arrives in time counts, everything else keeps the default of 0.

States and scores are joined within a range of event time, so the same function holds for tables and for streams. On streams
both sides have watermarks: a score that comes later than its state's deadline never joins, a score whose event time lies
behind the watermark is dropped, and a state leaves the join's memory as soon as no score can be in time any more, with its
default then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import _col

#: Fixed values, in seconds: what a deadline has beyond its calls, and what it is at least.
BUILD_SPARE, BUILD_LEAST = 60, 40
JUDGE_SPARE = 60
QUESTIONS_SPARE, QUESTIONS_LEAST = 30, 60


def build_deadline(timeout: Column | str, rounds: Column | str, questions: Column | str) -> Column:
    """Seconds for a build's test questions, asked one after the other."""
    return F.greatest(_col(timeout) * _col(rounds) * _col(questions) + BUILD_SPARE, F.lit(BUILD_LEAST))


def questions_deadline(timeout: Column | str, rounds: Column | str, questions: Column | str, workers: Column | str) -> Column:
    """Seconds for a build's test questions, asked by so many workers; a round is a call of the model and one of a tool."""
    turns = F.ceil(_col(questions) / _col(workers))
    return F.greatest(turns * _col(rounds) * 2 * _col(timeout) + QUESTIONS_SPARE, F.lit(QUESTIONS_LEAST))


def judge_deadline(timeout: Column | str, questions: Column | str) -> Column:
    return _col(timeout) * _col(questions) + JUDGE_SPARE


def scores_in_time(states: DataFrame, scores: DataFrame, key: str = "key", late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """states (key, asked_at, deadline in seconds, ...) with score and in_time, from scores (key, scored_at, score), at most one a key.

    longest bounds all deadlines, so that a stream knows when a state is done; late is how far event times of a side may lag.
    A null key, deadline or time has no score in time; a null score in time counts as 0.
    """
    own = states.withWatermark("asked_at", late)
    given = scores.select(F.col(key).alias("_key"), "scored_at", F.col("score").alias("_score")).withWatermark("scored_at", late)
    due = F.col("asked_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("deadline").cast("decimal(18,6)"))
    bounds = (F.col("scored_at") >= F.col("asked_at")) & (F.col("scored_at") <= F.col("asked_at") + F.expr(f"INTERVAL {longest}"))
    rows = own.join(given, (own[key] == F.col("_key")) & bounds & (F.col("scored_at") <= due), "left_outer")
    return rows.select(*states.columns, F.coalesce("_score", F.lit(0.0)).alias("score"), F.col("_key").isNotNull().alias("in_time"))
