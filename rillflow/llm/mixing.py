"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words (a share of the whole by weight, filled like connected vessels below a cap
per source). A document is wanted `lam` times: its whole copies are certain, and its remainder is its inclusion
probability. Documents are ranked by random odds over inclusion odds; the first ones are taken until the source's
remaining words are met as nearly as whole documents allow. The random number is a hash of id, text and seed, so reruns
agree.

No task sees a whole source: ranks are cut into bins, bins are summed, and only the one bin of a source in which its
cut falls is ordered by row.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows of size 0 are taken
with 0 words; an empty table gives an empty result; equal rows are each a document of their own (which of them is
taken can't be told apart); other columns of the input stay as they are, unless they bear the name of a result column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import WORD, materialize, table

BINS = 4096
#: Steps of merit to each doubling, for the level that meets a source's target.
MERIT_STEPS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of key and text: rows without an id of their own are drawn apart."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, target from rows of (source, size). Only sums by source reach the unpartitioned windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")))
    whole = Window.partitionBy()
    rising = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("w_all", F.sum("w").over(whole))
        .withColumn("s_before", F.coalesce(F.sum("source_size").over(rising), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(rising), F.lit(0)))
    )
    # The level if the sources before this one are at their caps and it and all later ones are below: it rises with each
    # source that is truly capped and falls from the first that is not, so the greatest is the right one.
    level = (F.lit(float(share)) * F.col("total") - F.lit(float(cap)) * F.col("s_before")) / (F.col("w_all") - F.col("w_before"))
    per = per.withColumn("level", F.max(level).over(whole))
    return per.select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def mix(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    merit: str | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken), one row per row of df.

    merit names a positive column that a document's wanted copies are in proportion to within its source, up to cap (null:
    none are wanted); without it all documents of a source are wanted equally.
    """
    rows = df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), unit_hash(F.col(key), F.col(text), seed).alias("u"),
        (F.coalesce(F.col(merit).cast("double"), F.lit(0.0)) if merit else F.lit(1.0)).alias("merit"),
    )
    rows = materialize(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, cap)
    # The level c at which the words wanted, cap or c * merit times a size, are the target: documents are taken as capped
    # from the greatest merit down, and of the levels that follow the greatest is right, as with the sources.
    step = F.when(F.col("merit") > 0, F.floor(F.log2("merit") * MERIT_STEPS))
    steps = rows.withColumn("step", step).where("step IS NOT NULL").groupBy("source", "step").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("merit")).alias("worth"))
    above = Window.partitionBy("source").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole_source = Window.partitionBy("source")
    steps = steps.select(F.col("source").alias("s"), F.coalesce(F.sum("words").over(above), F.lit(0)).alias("capped"), (F.sum("worth").over(whole_source) - F.coalesce(F.sum("worth").over(above), F.lit(0.0))).alias("worth"))
    targets = targets.join(steps, F.col("source").eqNullSafe(F.col("s")), "left")
    level = F.try_divide(F.col("target") - F.lit(float(cap)) * F.col("capped"), F.col("worth"))
    targets = targets.groupBy(F.col("source").alias("s"), "source_size", "target").agg(F.max(level).alias("level"))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    lam = F.least(F.lit(float(cap)), F.col("level") * F.col("merit"))
    rows = rows.withColumn("lam", F.greatest(F.lit(0.0), F.coalesce(lam, F.lit(0.0)))).withColumn("whole", F.floor("lam")).withColumn("pi", F.col("lam") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi")))
    rows = rows.withColumn("v", F.when(F.col("pi") > 0, odds / (1 + odds))).withColumn("bin", F.coalesce(F.floor(F.col("v") * BINS), -1 - F.floor(F.col("u") * BINS)).cast("int"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    by_source = Window.partitionBy("source")
    bins = bins.withColumn("rest", F.col("target") - F.sum("certain").over(by_source)).withColumn("words", F.when(F.col("bin") >= 0, F.col("words")).otherwise(0))
    bins = bins.withColumn("upto", F.sum("words").over(by_source.orderBy("bin"))).withColumn("before", F.col("upto") - F.col("words"))
    bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "rest", "upto", "before")
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    inside = (F.col("bin") >= 0) & (F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest"))
    ranked = Window.partitionBy("source", "bin").orderBy("v", "key", "size")
    cut = rows.where(inside).withColumn("cum", F.col("before") + F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("drawn", (F.col("cum") - F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("cum")
    clear = rows.where(~inside).withColumn("drawn", ((F.col("bin") >= 0) & (F.col("upto") <= F.col("rest"))).cast("long"))
    both = clear.unionByName(cut).withColumn("copies", F.col("whole") + F.col("drawn"))
    return both.select(F.col("key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
    coalesce(sum(source_size) OVER r, 0) AS s_before, coalesce(sum(w) OVER r, 0) AS w_before
  FROM s WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * s_before::DOUBLE) / (w_all - w_before)::DOUBLE AS lv FROM f
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(lv) OVER ()) AS target FROM g
), m AS (
  SELECT d.*, t.source_size, t.target, least(2.0::DOUBLE, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0.0::DOUBLE)) AS lam
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(lam) AS whole, lam - floor(lam) AS pi FROM m
), q AS (
  SELECT *, (u / (1 - u)) / (nullif(pi, 0) / (1 - pi)) AS odds, sum(whole * size) OVER (PARTITION BY source) AS certain FROM p
), k AS (
  SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM q
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN pi > 0 AND cum - size / 2.0::DOUBLE <= target - certain THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""
