"""Target-distribution importance resampling on hashed n-grams.

A text's words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII; its features are all
runs of 1 to ORDER words, joined by one space, repeats counted. A feature's bucket is its crc32 modulo BUCKETS. From the
features of the raw corpus and of a target corpus each bucket gets a gain, the scaled log ratio of the smoothed
distributions; a document's weight is the sum of its features' gains. Weights plus Gumbel noise, which a hash of the id
gives, order the documents, and the first ones are a sample without replacement in proportion to the weights.

Scoring explodes nothing: higher-order functions make a document's array of buckets, and aggregate() sums element_at of a
literal array of BUCKETS gains. Counts are taken over the same arrays, which are written once (about 1.8 bytes a feature); only totals of BUCKETS
buckets are shuffled, and only these reach the driver. A hot source or copies weigh on no task more than on others, as no row is shuffled by a key.

The draw orders no whole table in one task: documents long enough are dealt by ranges of (score, id) and written once with
the number of their range; a rank is the place in the range plus the sizes of the ranges before it.

Defined results: a null text has no features, weight 0 and is not drawn; a null id is hashed as the empty text and comes last
among ties; repeated rows are each a document, drawn one after the other; an empty raw or target corpus counts as uniform;
an empty table gives an empty result. Other columns stay, unless they bear the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import lower_ascii, materialize, spread, table

BUCKETS = 10_000
ORDER = 3
SEED = 42
MIN_WORDS = 20
#: Hundredths of the documents long enough that are drawn.
PERCENT = 5
#: What parts words.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_features", "weight", "score", "rank")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), PARTING), "")


def bucket_array(words: str, order: int = ORDER, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to `order` words of an array column."""
    runs = []
    for n in range(1, order + 1):
        run = "concat(" + ", ' ', ".join(["x", *(f"get({words}, i + {k})" for k in range(1, n))]) + ")"
        runs.append(f"transform(slice({words}, 1, greatest(0, size({words}) - {n - 1})), (x, i) -> CAST(crc32({run}) % {buckets} AS INT))")
    return F.expr(f"concat({', '.join(runs)})")


def bucketed(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """Kept columns, n_words, buckets."""
    rows = df.select(*keep, terms(F.col(text)).alias("words"))
    return rows.select(*[c for c in rows.columns if c != "words"], F.size("words").alias("n_words"), bucket_array("words").alias("buckets"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """Features by bucket, of rows with buckets: at most BUCKETS totals reach the driver, and as many from each task are
    shuffled. The outer form keeps the optimizer from computing the array once more for a filter on its size."""
    totals = rows.select(F.explode_outer("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).where("b IS NOT NULL")
    return {r["b"]: r["n"] for r in totals.collect()}


def gain_table(raw: dict[int, int], target: dict[int, int], spark: SparkSession, buckets: int = BUCKETS) -> list[int]:
    """Gains by bucket, in Spark's arithmetic: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    rows = spark.createDataFrame([(b, float(raw.get(b, 0) + 1), float(target.get(b, 0) + 1)) for b in range(buckets)], "b int, s double, t double")
    gain = F.floor(1000 * F.log((F.col("t") * F.lit(all_raw)) / (F.col("s") * F.lit(all_target)))).cast("long")
    return [r["g"] for r in rows.select("b", gain.alias("g")).orderBy("b").collect()]


def weigh(rows: DataFrame, gains: list[int]) -> DataFrame:
    """Rows with n_features and weight instead of buckets."""
    literal = F.expr(f"cast(split('{','.join(map(str, gains))}', ',') AS array<bigint>)")  # folded to one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    return rows.select(*[c for c in rows.columns if c != "buckets"], F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (row, key, n_words, n_features, weight, score) with rank: 1, 2, 3 ... for the drawn, else null."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), "n"]
    # Equal rows of one id are told apart by n, so that ranges can part them.
    rows = scored.withColumn("n", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.where(F.col("n_words") >= min_words).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "resampling-ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("here"))  # a row for each partition
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("range", (F.sum("here").over(upto) - F.col("here")).alias("before"), F.floor(F.lit(percent) * F.sum("here").over(Window.partitionBy()) / 100).alias("wanted"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = ranged.join(F.broadcast(sizes), "range").withColumn("rank", place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).cast("long"))
    columns = ["row", "key", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """df without its text, with n_features, weight, score and rank (null: not drawn). Arrays of buckets are written once, so
    texts are cut once for the counts and the weights."""
    spark = df.sparkSession
    own = [c for c in df.columns if c != text and c.lower() not in RESULT]
    carried = F.struct(*[df[c] for c in own if c != key] or [F.lit(0).alias("nothing")]).alias("row")
    rows = materialize(bucketed(df, text, carried, df[key].alias("key")), "resampling-buckets")
    gains = gain_table(bucket_counts(rows), bucket_counts(bucketed(target, target_text)), spark)
    scored = materialize(weigh(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("key"))), "resampling-scores")
    return draw(scored, percent, min_words).select(*[F.col("key").alias(c) if c == key else F.col("row")[c].alias(c) for c in own], *RESULT)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resample(docs, table(spark, sf_dir, "benchmark"))


SQL = """
WITH RECURSIVE k(i, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM k WHERE step = 8),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words
), hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
named AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), found AS (SELECT side, r, bucket FROM features JOIN named USING (f)),
per AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM found GROUP BY bucket),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM per),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((per.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE) / ((per.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM per, total
), weights AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    floor(5 * count(*) FILTER (WHERE n_words >= 20) OVER () / 100) AS wanted FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM ranked
"""
