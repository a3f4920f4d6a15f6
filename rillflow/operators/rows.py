"""Row operators: keep-first dedup, splits, top-k, routing, positional alignment, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; never an arbitrary survivor. A constant-size aggregate per key, no sort of groups."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def alias_eval(df: DataFrame) -> DataFrame:
    return df.withColumns({"inputs": F.col("question"), "targets": F.col("answer")})


def cumulative_cap(df: DataFrame, band: str, order: str, per_band: int) -> DataFrame:
    """Keeps rows with an answer, in order of band, up to per_band times the bands so far: a short band is topped up by the next."""
    rows = df.where("answer IS NOT NULL")
    counts = rows.groupBy(F.col(band).alias("_band")).agg(F.count("*").alias("_n"))
    every = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per band
    counts = counts.withColumn("_cap", F.row_number().over(Window.orderBy("_band")) * per_band).withColumn("_upto", F.sum("_n").over(every))
    # The rows kept so far are what the tightest of the caps up to here leaves: all since then, or all there are.
    counts = counts.withColumn("_kept", F.col("_upto") + F.least(F.lit(0), F.min(F.col("_cap") - F.col("_upto")).over(every)))
    takes = counts.select("_band", (F.col("_kept") - F.coalesce(F.lag("_kept").over(Window.orderBy("_band")), F.lit(0))).alias("_take"))
    ranked = rank_within(rows, band, order, "_rn").join(takes, F.col(band).eqNullSafe(F.col("_band")))
    return ranked.where("_rn <= _take").select(*df.columns)


def rank_within(df: DataFrame, by: str, order: str, name: str, ranges: int = 64) -> DataFrame:
    """df with `name`: a row's number within `by` in order of `order` (a number; equal ones in any order, null ones first).

    A key's rows are cut into ranges at quantiles, numbered range by range and offset by the rows before, so no task orders
    a whole key, however few keys there are.
    """
    cuts = df.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    rows = df.join(cuts, F.col(by).eqNullSafe(F.col("_by")))
    rows = rows.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))).drop("_by", "_cuts")
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)))
    rows = rows.join(counts.select("_by", "_r", before.alias("_before")), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def newest_per_key(df: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("rn") <= n)


def shuffled_rank(key: Column, seed: int, *partition: str) -> Column:
    """A reproducible random order: by a hash of seed and key."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.xxhash64(F.lit(seed), key), key))


def reference_and_test(df: DataFrame, key: str, by: str, seed: int, reference: int = 10, test: int = 100) -> DataFrame:
    """The first rows of a shuffle as few-shot examples, the next as test questions; column part. Per task, so a task's rows are ranked apart."""
    rank = shuffled_rank(F.col(key), seed, by)
    part = F.when(F.col("_r") <= reference, "reference").when(F.col("_r") <= reference + test, "test")
    return df.withColumn("_r", rank).withColumn("part", part).where("part IS NOT NULL").drop("_r")


def best_proposal(proposals: DataFrame, by: str | None = None) -> DataFrame:
    """The most accurate attempt; ties keep the first."""
    keys = [by] if by else []
    rest = [c for c in proposals.columns if c not in keys]
    best = proposals.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("accuracy", -F.col("attempt"))).alias("b"))
    return best.where("b IS NOT NULL").select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def route(prompts: DataFrame, pool: DataFrame, key: str = "category") -> tuple[DataFrame, DataFrame]:
    """Use prompts that the pool covers, and all others (which need a tool built first)."""
    covered = pool.select(key).distinct()
    use = prompts.where(F.lower(F.coalesce("task_type", F.lit("use"))) == "use")
    other = prompts.where(F.lower(F.coalesce("task_type", F.lit("use"))) != "use")
    return use.join(covered, key, "left_semi"), use.join(covered, key, "left_anti").unionByName(other)


def with_scores(states: DataFrame, scores: DataFrame, key: str, value: str = "score") -> DataFrame:
    """Results that did not arrive count as 0."""
    return states.join(scores, key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def without_overlap(test: DataFrame, train: DataFrame, key: str = "question") -> DataFrame:
    return test.join(train.select(key).distinct(), key, "left_anti")


def assert_all(df: DataFrame, fine: Column, message: str) -> DataFrame:
    """Aborts the query at the first row that fails; see quarantine for the other way."""
    return df.where(F.assert_true(fine, message).isNull())


def quarantine(df: DataFrame, fine: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(fine, F.lit(False))
    return df.where(ok), df.where(~ok)
