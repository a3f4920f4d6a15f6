"""Quality classifier: similarity-weighted votes of the nearest labelled texts in a latent semantic space.

Texts become TF-IDF vectors of hashed byte pairs and of word repetition; a truncated SVD of a bounded sample of labelled
texts (LABELLED rows) spans the latent space. The labelled vectors are broadcast (their size is bounded by LABELLED and
RANK), every document's cosines with all of them are computed exactly, in blocks, and its NEAREST labels vote.

Defined results: a null or empty text, like any text without a single feature, scores the labelled texts' share of
label 1 (0.5 if there is none); repeated rows are each scored; equal texts score alike; whole texts are read whatever
their length; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import slices, spread, table
from rillflow.llm.labelled import fold, labelled_sample

#: Labelled rows that the model is fitted on, at most.
LABELLED = 4096
BUCKETS = 2048
EXTRA = 3
RANK = 64
NEAREST = 31
SHARPNESS = 20.0
BLOCK = 256


def counts(text: str) -> np.ndarray:
    """Hashed counts of byte pairs, then word repetition: next to each other, anywhere, and of whole lines."""
    out = np.zeros(BUCKETS + EXTRA, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data) - 1, 1 << 20):  # in steps, so that a very long text takes bounded memory
        part = data[at : at + (1 << 20) + 1].astype(np.uint32)
        out[:BUCKETS] += np.bincount(((part[:-1] * 256 + part[1:]) * np.uint32(2654435761) >> 15) % BUCKETS, minlength=BUCKETS)
    parts = text.split()
    if parts:
        lines = text.split("\n")
        out[BUCKETS] = 4 * sum(map(str.__eq__, parts, parts[1:])) / len(parts)
        out[BUCKETS + 1] = 1 - len(set(parts)) / len(parts)
        out[BUCKETS + 2] = 1 - len(set(lines)) / len(lines)
    return out


class LatentModel:
    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.prior = float(labels.mean()) if len(labels) else 0.5
        df = (rows > 0).sum(0) if len(rows) else np.zeros(BUCKETS + EXTRA)
        self.idf = (np.log((1 + len(rows)) / (1 + df)) + 0.1).astype(np.float32)
        self.idf[BUCKETS:] = 1.0
        x = self.weigh(rows)
        # A few steps of subspace iteration from a fixed start give the leading right singular vectors.
        basis = np.random.default_rng(7).standard_normal((BUCKETS + EXTRA, RANK + 16)).astype(np.float32)
        for _ in range(6 if len(x) else 0):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        if len(x):
            basis = basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T
        self.basis = np.ascontiguousarray(basis[:, :RANK], np.float32)
        self.vectors = self.project(x)
        self.labels = labels.astype(np.float32)

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        x = np.array(rows, np.float32)  # the one copy
        pairs = x[:, :BUCKETS]
        pairs /= np.maximum(pairs.sum(1, keepdims=True), 1)
        np.sqrt(pairs, out=pairs)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEAREST, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            rows = np.stack([counts(t) for t in texts[at : at + BLOCK]])
            cos = self.project(self.weigh(rows)) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            votes = np.exp(SHARPNESS * (np.take_along_axis(cos, near, 1).astype(np.float64) - 1))
            vote = (votes * self.labels[near]).sum(1) / votes.sum(1)
            out[at : at + BLOCK] = np.where(rows.any(1), np.clip(vote, 0, 1), self.prior)
        return out


def _ordered(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels in order of (key, row). The counts are copied once, so the driver holds few copies of them."""
    order = pc.sort_indices(got, sort_keys=[("key", "ascending"), ("row", "ascending")]).to_numpy()
    matrix, at = np.empty((got.num_rows, BUCKETS + EXTRA), np.float32), np.empty(got.num_rows, np.int64)
    at[order] = np.arange(got.num_rows)
    for i, row in zip(at, (x for chunk in got["row"].chunks for x in chunk), strict=True):
        matrix[i] = np.frombuffer(row.as_buffer(), np.float32)
    return matrix, got["label"].to_numpy()[order].astype(np.float32)


def fit(sample: DataFrame) -> LatentModel:
    """sample: (key, text, label), of bounded size. Only its feature counts reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, label, text = batch.columns
            yield pa.record_batch([key, label, pa.array([counts(t).tobytes() for t in text.to_pylist()], pa.binary())], names=["key", "label", "row"])

    rows = sample.select(F.col("key").cast("string").alias("key"), "label", "text")
    got = rows.mapInArrow(features, "key string, label int, row binary").toArrow()
    return LatentModel(*_ordered(got))


def score(df: DataFrame, model: LatentModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): the likelihood of label 1, for every row of df."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()), pa.float64())], names=[key, "score"])

    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, f"`{key}` {df.schema[key].dataType.simpleString()}, score double")


def keep(df: DataFrame, model: LatentModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose score is `least` or more, in one pass over their texts."""
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(sent.value.score([t or "" for t in batch.column(at).to_pylist()]) >= least))

    return df.mapInArrow(choose, df.schema)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> LatentModel:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 3) != 1, LABELLED))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spread(table(spark, sf_dir, "documents")), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
