"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings of words. From a bounded sample of labelled texts (LABELLED rows) the TERMS terms that
point to label 1 most clearly (by chi squared, of those commoner in it) are indexed; all other words together are one more term of small weight, so a
vector's direction says how frequent the indexed terms are. Postings are grouped in blocks of examples with the greatest
weight of each block: a query visits blocks in order of their bounds and stops when no bound can beat its K-th best
cosine, which keeps the result exact. Neighbours vote with the inverse of their distance, and the votes are calibrated: each
example is voted on by the others, and votes count what share of the examples with such votes has label 1.

The index is of chosen terms because all terms give wrong results: rare ordinary words outweigh those that tell (README).

Defined results: a null or empty text, or one without words, scores the examples' share of label 1 (0 if there is none);
repeated rows are each scored; equal texts score alike; whole texts are read; other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, slices, spread, table
from rillflow.llm.labelled import fold, labelled_sample

#: Labelled rows that are indexed, at most.
LABELLED = 4096
TERMS = 256
STEMS = range(3, 8)
LEAST_DOCUMENTS = 8
OTHER_WEIGHT = 0.03
NEAREST = 25
BLOCK = 64
NEARLY = 1e-4
CACHE_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def text_terms(text: str) -> tuple[Counter, int]:
    found = Counter(LETTERS.findall(text.lower()))
    terms: Counter = Counter()
    for word, n in found.items():
        for t in word_terms(word):
            terms[t] += n
    return terms, sum(found.values())


class BlockMaxIndex:
    """Examples as rows of weights; the last column is the term that stands for all other words."""

    def __init__(self, terms: list[str], idf: np.ndarray, rows: np.ndarray, labels: np.ndarray, keys: list) -> None:
        norm = np.linalg.norm(rows * idf, axis=1, keepdims=True)
        rows = rows * idf / np.maximum(norm, 1e-300)
        order = np.lexsort((np.arange(len(rows)), -rows.max(1), rows.argmax(1))) if len(rows) else np.zeros(0, int)  # alike examples share blocks
        rows, self.labels, self.keys = rows[order], labels[order].astype(float), [keys[i] for i in order]
        self.column = {t: j for j, t in enumerate(terms)}
        self.idf, self.size = idf, len(rows)
        self.prior = float(labels.mean()) if len(labels) else 0.0
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []  # by term and block: examples, weights
        blocks = -(-len(rows) // BLOCK)
        self.bounds = np.zeros((len(idf), blocks))
        for j in range(len(idf)):
            at = np.nonzero(rows[:, j])[0]
            parts = {}
            for b in np.unique(at // BLOCK):
                own = at[at // BLOCK == b]
                parts[int(b)] = (own - b * BLOCK, rows[own, j])
                self.bounds[j, b] = rows[own, j].max()
            self.postings.append(parts)
        self.words: dict[str, tuple[int, ...]] = {}
        self.seen: dict[bytes, tuple[float, list]] = {}
        self.curve = (np.zeros(0), np.zeros(0))
        if len(rows):
            self.calibrate(rows)

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Columns and counts of the indexed terms and of all words."""
        found = LETTERS.findall(text.lower())
        if not found:
            return None
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        known, hits = self.words, []
        for word in found:
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(j for t in word_terms(word) if (j := self.column.get(t)) is not None)
            if got:
                hits += got
        columns, n = np.unique(np.array([*hits], np.int64), return_counts=True)
        return np.append(columns, len(self.idf) - 1), np.append(n, len(found)).astype(float)

    def nearest(self, columns: np.ndarray, n: np.ndarray, most: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the `most` nearest examples; ties go to the earlier position."""
        w = n * self.idf[columns]
        w = w / np.linalg.norm(w)
        bounds = w @ self.bounds[columns]
        k = min(most, self.size)
        ids, cos, worst = np.zeros(0, np.int64), np.zeros(0), -1.0
        for b in np.argsort(-bounds, kind="stable"):
            if len(ids) >= k and bounds[b] < worst - 1e-12:
                break
            score = np.zeros(min(BLOCK, self.size - b * BLOCK))
            for j, x in zip(columns, w, strict=True):
                if (part := self.postings[j].get(int(b))) is not None:
                    score[part[0]] += x * part[1]
            ids, cos = np.append(ids, b * BLOCK + np.arange(len(score))), np.append(cos, score)
            keep = np.lexsort((ids, -np.round(cos, 12)))[:k]
            ids, cos = ids[keep], cos[keep]
            worst = cos[-1]
        return ids, cos

    def share(self, ids: np.ndarray, cos: np.ndarray) -> float:
        """The neighbours' votes for label 1, each weighted by the inverse of its distance."""
        weight = 1 / (1 - np.minimum(cos, 1) + NEARLY)
        return float((weight * self.labels[ids]).sum() / weight.sum())

    def calibrate(self, rows: np.ndarray) -> None:
        """Fits the curve from votes to the frequency of label 1 among examples that got such votes from the others.

        rows: the examples' weights. The curve never falls (adjacent violators are pooled) and is a line between pools.
        """
        votes = np.empty(len(rows))
        for i, row in enumerate(rows):
            columns = np.nonzero(row)[0]
            ids, cos = self.nearest(columns, row[columns] / self.idf[columns], NEAREST + 1)
            other = ids != i
            votes[i] = self.share(ids[other][:NEAREST], cos[other][:NEAREST]) if other.any() else self.prior
        pools: list[list[float]] = []  # sum of votes, sum of labels, number
        for i in np.argsort(votes, kind="stable"):
            pools.append([votes[i], self.labels[i], 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.curve = (np.array([v / n for v, _, n in pools]), np.array([y / n for _, y, n in pools]))

    def calibrated(self, vote: float) -> float:
        """The vote on the curve; beyond its ends half way on to 0 or 1, so more votes never score less."""
        at, to = self.curve
        if not len(at):
            return vote
        if vote < at[0]:
            return float(to[0] * (1 + vote / at[0]) / 2)
        if vote > at[-1]:
            return float(to[-1] + (1 - to[-1]) * (vote - at[-1]) / (1 - at[-1]) / 2)
        return float(np.interp(vote, at, to))

    def vote(self, text: str) -> tuple[float, list]:
        """Score, and the three nearest examples as (key, cosine, label)."""
        found = self.query(text) if self.size else None
        if found is None:
            return self.prior, []
        mark = found[0].tobytes() + found[1].tobytes() if len(found[0]) > 1 else b"none"
        if mark not in self.seen:
            ids, cos = self.nearest(*found)
            if len(self.seen) > CACHE_WORDS:
                self.seen = {}
            self.seen[mark] = (self.calibrated(self.share(ids, cos)), [(self.keys[i], float(c), int(self.labels[i])) for i, c in zip(ids[:3], cos[:3], strict=True)])
        return self.seen[mark]


def fit(sample: DataFrame) -> BlockMaxIndex:
    """sample: (key, text, label), of bounded size; its texts' terms are counted on the executors."""

    def counted(batches):
        for pdf in batches:
            rows = [text_terms(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "words": [n for _, n in rows], "terms": [list(c) for c, _ in rows], "n": [list(c.values()) for c, _ in rows]})

    texts = sample.select(F.col("key").cast("string").alias("key"), "label", "text")
    rows = materialize(texts.mapInPandas(counted, "key string, label int, words long, terms array<string>, n array<long>"), "toxic-terms")
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    size, toxic = total["n"], total["p"] or 0
    per = rows.select("label", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("d"), F.sum("label").alias("a")).where(F.col("d") >= LEAST_DOCUMENTS)
    part = F.col("a") * (size - toxic) - (F.col("d") - F.col("a")) * toxic
    chi = part * F.abs(part) / (F.col("d") * (size - F.col("d")) + 1.0)
    best = per.orderBy(chi.desc(), "t").where(part > 0).limit(TERMS).collect()  # at most TERMS rows
    terms = [r["t"] for r in best]
    idf = np.array([np.log(1 + (size - r["d"] + 0.5) / (r["d"] + 0.5)) for r in best] + [OTHER_WEIGHT])
    column = {t: j for j, t in enumerate(terms)}
    wanted = rows.select("key", "label", "words", F.expr("filter(arrays_zip(terms, n), x -> array_contains(array(" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "), x.terms))").alias("z")) if terms else rows.select("key", "label", "words", F.lit(None).alias("z"))
    got = sorted(wanted.collect(), key=lambda r: (r["key"], r["words"]))  # at most LABELLED rows of TERMS numbers
    matrix = np.zeros((len(got), len(terms) + 1))
    for i, r in enumerate(got):
        matrix[i, -1] = r["words"]
        for x in r["z"] or ():
            matrix[i, column[x["terms"]]] = x["n"]
    return BlockMaxIndex(terms, idf, matrix, np.array([r["label"] for r in got], float), [r["key"] for r in got])


def score(df: DataFrame, index: BlockMaxIndex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, evidence): evidence holds the three nearest examples with cosine and label."""
    sent = df.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [sent.value.vote(t) for t in batch.column(1).to_pylist()]
            near = [[{"id": str(k), "cosine": c, "label": y} for k, c, y in e] for _, e in got]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(near, evidence)], names=[key, "score", "evidence"])

    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, f"`{key}` {df.schema[key].dataType.simpleString()}, score double, evidence array<struct<id: string, cosine: double, label: int>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0, LABELLED))
    return score(spread(docs), index).select("doc_id", "evidence", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
