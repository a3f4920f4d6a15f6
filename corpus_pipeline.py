"""A training corpus from `documents`: quality, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents;
the last returns the packed pieces. Results of stages are written to the shared folder and reread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import linededup, mixing, neardup, packing, quality
from rillflow.llm.common import materialize, table, workers_import


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    workers_import(spark)
    return quality.keep(docs, quality.quality_model(spark, sf_dir, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines alike the first in order of document and line stays; n_chars follows the text."""
    clean = linededup.dedup_lines(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[length.alias(c) if c == "n_chars" else clean[c] for c in docs.columns])


def identity(*values: Column) -> Column:
    """128 bits of the values; nulls, which a hash leaves out, are told by flags."""
    told = [x for v in values for x in (v.isNull(), v)]
    return F.struct(F.xxhash64(*told).alias("h0"), F.xxhash64(F.lit(1), *told).alias("h1"))


def whole(docs: DataFrame) -> Column:
    """A row as one struct: its columns' names then clash with none of a stage's own."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("doc")


def one_of_each(rows: DataFrame, order: Column) -> DataFrame:
    """One row of each `row`, the first in order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(order))).where("n = 1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, null ids last and by text hash within an id; of repeated rows
    of it, one. Documents are told apart by id and text, so unlike texts with one id, or none, are each a document."""
    row = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0)).alias("id"), identity(F.col("text")).alias("text"))
    rows = docs.select(whole(docs), row.alias("row"), "text")
    stays = neardup.near_duplicates(rows, key="row").where("component = row").select("row").distinct()
    every = identity(*[F.col("doc")[c] for c in docs.columns])
    return one_of_each(rows.select("doc", "row").join(stays, "row"), every).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it. Equal rows are drawn each; one of them then stands for all."""
    rows = docs.select(whole(docs), identity(*[docs[c] for c in docs.columns]).alias("row"), "text", "source")
    drawn = mixing.mix(rows, key="row").groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    taken = one_of_each(rows.select("doc", "row").join(drawn, "row"), F.col("row"))
    return taken.select("doc", F.explode(F.expr("sequence(1, copies)"))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, MinHash and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
