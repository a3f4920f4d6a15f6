"""Nearest neighbours by largest inner product over vantage-point trees, one per shard.

A vector v with |v| <= M becomes the point (v, sqrt(M^2 - |v|^2)) and a query q the point (q, 0): their squared distance
is |q|^2 + M^2 - 2 q.v, so the nearest point has the largest inner product. Each shard (about SHARD vectors, dealt by a
hash of the id) is one tree over its distinct points. A search descends to the side of the query first and visits the
other side only if  relax * (distance to the boundary) < (distance to the K-th best so far); relax 1 is the exact
search, a larger one prunes more.

A task holds one tree and up to about QUERIES queries, both of bounded size: the tree is made once for them, and they go
through it in blocks. Each shard gives at most K rows a query, and these are ranked at last.

Defined results: vectors that are null, zero or hold null or non-finite components take no part on either side; vectors
of different lengths never meet; copies of a vector are each a candidate, in order of their ids; rows equal in id and
vector are one candidate; all that tie with the K-th are considered, however many, and the smaller ids stay; a query that
occurs more than once counts once (its greatest vector); candidates with the query's own id are left out; rows with a null
id take no part; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, table

SHARD = 16384
QUERY_BLOCK = 512
QUERIES = 1 << 16
LEAF = 256
#: Further distinct vectors kept while searching, and the relative difference up to which blocked products may be ties.
SPARE = 8
TIE = 1e-9


class VantageTree:
    """points: distinct rows, augmented. Nodes are [vantage, radius, inside, outside] or leaves of positions."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.root = self._build(np.arange(len(points)), np.random.default_rng(len(points)))

    def _build(self, own: np.ndarray, random: np.random.Generator):
        if len(own) <= LEAF:
            return own
        # Of a few candidates, the vantage point whose distances spread most.
        best = max(random.choice(own, 5, replace=False), key=lambda c: np.linalg.norm(self.points[own[:512]] - self.points[c], axis=1).std())
        distance = np.linalg.norm(self.points[own] - self.points[best], axis=1)
        radius = float(np.median(distance))
        inside = distance <= radius
        if inside.all():
            return own
        return (int(best), radius, self._build(own[inside], random), self._build(own[~inside], random))

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of about the k nearest points of each query, nearest first; -1 where there are fewer."""
        self.ids = np.full((len(queries), k), -1)
        self.best = np.full((len(queries), k), np.inf)
        self.scanned = 0
        if len(self.points):
            self._visit(self.root, np.arange(len(queries)), queries, k, relax)
        return self.ids, self.best

    def _visit(self, node, active: np.ndarray, queries: np.ndarray, k: int, relax: float) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            q, p = queries[active], self.points[node]
            self.scanned += len(active) * len(node)
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (q @ p.T), 0))
            d = np.hstack([self.best[active], d])
            ids = np.hstack([self.ids[active], np.broadcast_to(node, (len(active), len(node)))])
            keep = np.argpartition(d, k - 1, axis=1)[:, :k]
            d, ids = np.take_along_axis(d, keep, 1), np.take_along_axis(ids, keep, 1)
            order = np.argsort(d, axis=1, kind="stable")
            self.best[active], self.ids[active] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
            return
        vantage, radius, inside, outside = node
        gap = np.linalg.norm(queries[active] - self.points[vantage], axis=1) - radius
        near = gap <= 0
        self._visit(inside, active[near], queries, k, relax)
        self._visit(outside, active[~near], queries, k, relax)
        reach = relax * np.abs(gap) <= self.best[active, -1]
        self._visit(outside, active[near & reach], queries, k, relax)
        self._visit(inside, active[~near & reach], queries, k, relax)


class ShardSearch:
    """The K best candidates of a shard for blocks of queries: the tree finds them, and ties that it could cut are counted out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, k: int, relax: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.points, back = np.unique(vectors[order], axis=0, return_inverse=True)
        # Copies of a vector rank by id, so the first k + 1 of each (one may be the query itself) are all that can count.
        by = np.argsort(back, kind="stable")
        nth = np.arange(len(by)) - np.searchsorted(back[by], back[by])
        by = by[nth <= k]
        self.ids, self.at, self.k, self.relax = ids[order][by], back[by], k, relax
        norm2 = (self.points * self.points).sum(1)
        self.tree = VantageTree(np.hstack([self.points, np.sqrt(np.maximum(most - norm2, 0))[:, None]]))

    def best(self, own: int, q: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best among the found points' ids, without the query's own; ties go to smaller ids."""
        score = (self.points[found] * q).sum(1)  # the same sum for equal vectors, wherever they lie
        first, last = np.searchsorted(self.at, found), np.searchsorted(self.at, found, side="right")
        ids = np.concatenate([self.ids[a:b] for a, b in zip(first, last, strict=True)])
        score = np.repeat(score, last - first)
        ids, score = ids[ids != own], score[ids != own]
        keep = np.lexsort((ids, -score))[: self.k]
        return ids[keep], score[keep]

    def search(self, qids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        held = min(self.k + 1 + SPARE, len(self.points))
        found, far = self.tree.search(np.hstack([queries, np.zeros((len(queries), 1))]), held, self.relax)
        out = []
        for own, q, near, d in zip(qids, queries, found, far, strict=True):
            ok = near >= 0
            # Where the last one held lies as far as the k + 1st, up to rounding, more may tie with it than were held.
            if held < len(self.points) and d[-1] <= d[min(self.k, held - 1)] * (1 + TIE) + TIE:
                near, ok = self._ties(q, float((self.points[near[ok]] * q).sum(1).min())), slice(None)
            ids, score = self.best(own, q, near[ok])
            out.append(pd.DataFrame({"query_id": own, "id": ids, "score": score}))
        return pd.concat(out)

    def _ties(self, q: np.ndarray, least: float) -> np.ndarray:
        """All points that score at least about `least`, from the whole shard."""
        score = (self.points * q).sum(1)
        return np.nonzero(score >= least - TIE * max(1.0, abs(least)))[0]


def nearest(df: DataFrame, is_query: Column, k: int = 20, relax: float = 2.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of each query's k nearest found; score is the inner product in double precision."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    fine = "v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = materialize(rows.where(fine).withColumn("norm2", F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).withColumn("dim", F.size("v")), "vp-rows")
    # One row for each length there is; where they are many, this is a join like any other.
    plan = rows.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count_if("q") / QUERIES).cast("int").alias("chunks"), F.max("norm2").alias("most"))
    rows = rows.join(materialize(plan, "vp-lengths"), "dim")
    # Repeated rows become one before they are moved, so no shard grows with them.
    points = rows.select("dim", "chunks", "most", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("shard"), "id", "v").distinct()
    points = points.select("dim", "shard", "most", "id", "v", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")).where("chunk >= 0")
    queries = rows.where("q").groupBy("dim", "shards", "chunks", "id").agg(F.max("v").alias("v"))
    # New names for the columns that both sides took from rows.
    queries = queries.select(F.col("dim").alias("dim"), F.col("id").alias("id"), "v", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"))

    def look(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        stack = lambda pdf: np.stack(pdf["v"].to_numpy()).astype(np.float64)
        shard = ShardSearch(own["id"].to_numpy(), stack(own), float(own["most"].iloc[0]), k, relax)
        qids, q = asked["id"].to_numpy(), stack(asked)
        return pd.concat([shard.search(qids[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK]) for at in range(0, len(qids), QUERY_BLOCK)])

    place = ["dim", "shard", "chunk"]
    found = points.groupBy(*place).cogroup(queries.groupBy(*place)).applyInPandas(look, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
