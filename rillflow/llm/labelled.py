"""A bounded sample of labelled texts, and the folds that keep rows out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the text 'null'."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, label) of at most `bound` labelled documents, chosen by a hash of the key.

    learn is a condition on the labels' key. Rows without key or label are no examples; of several labels of a document
    the greatest counts; of several texts of a document the one with the smallest hash, so `bound` holds for rows too.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64(key), key).limit(bound).select(F.col(key).alias("key"), "label")
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(rows), "key")  # at most `bound` rows of two numbers are sent
    return texts.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("key", "x.text", "label")
