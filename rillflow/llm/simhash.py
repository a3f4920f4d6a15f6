"""SimHash fingerprints in DataFrame functions: signed votes on bits as packed counters.

Every term hash is exploded into a row and its 64 bits are added to 32 sums of two 32-bit counters each, within
generated code and before any shuffle; one row per text leaves the task that read it.

Document fingerprints (op4): terms are pairs of neighbouring words, weighted by how often they occur; 128 bits.
`neighbours` finds all fingerprints within a Hamming radius by permuted block tables; the query looks up every edited
text's fingerprint among those of all documents.

Defined results: a null text is an empty one, whose fingerprint is all zero; a text of one word has that word as its
only term; equal texts have equal fingerprints; repeated rows are each returned (for op4, the row after those equal
in id and text is that of the next id or text, and they are all alike); a null id comes last in descending order and counts as the smallest 64-bit number; an empty table gives an empty result;
other columns are not used.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, table, words

#: The Hamming radius of the search, and the blocks that a fingerprint's 128 bits are cut into for it.
RADIUS = 3
BLOCKS = 5
#: Ranges of ids, at most, in which the next document is looked for.
RANGES = 4096
#: Bits j and j + 32, as one 64-bit number with two counters.
PAIR = (1 << 32) + 1


def fingerprints(df: DataFrame, keys: list[str], hashes: str, halves: int = 1) -> DataFrame:
    """keys and fp0 .. (64-bit numbers), a row per row of df; df's `hashes` is an array of 64-bit term hashes.

    Bit j is 1 if it is set in over half of the hashes. Each further half votes with the hash of the hash.
    """
    rows = df.select(*keys, F.posexplode_outer(hashes).alias("at", "h0"))
    for i in range(1, halves):
        rows = rows.withColumn(f"h{i}", F.when(F.col("h0").isNotNull(), F.xxhash64(f"h{i - 1}")))  # the hash of null is a number
    sums = [F.sum(F.expr(f"shiftrightunsigned(h{i}, {j}) & {PAIR}L")).alias(f"s{i}_{j}") for i in range(halves) for j in range(32)]
    got = rows.groupBy(*keys).agg(F.count("h0").alias("_n"), F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).cast("int").alias("_copies"), *sums)
    out = []
    for i in range(halves):
        counts = ", ".join(f"s{i}_{j}" for j in range(32))
        bit = lambda count, to: f"IF(({count}) * 2 > _n, shiftleft(1L, j + {to}), 0L)"
        out.append(F.expr(f"coalesce(aggregate(sequence(0, 31), 0L, (acc, j) -> acc | {bit(f'element_at(array({counts}), j + 1) & 4294967295L', 0)} | {bit(f'shiftrightunsigned(element_at(array({counts}), j + 1), 32)', 32)}), 0L)").alias(f"fp{i}"))
    # Rows with equal keys (ids and text) have voted together, which gives the same bits; they come apart again here.
    return got.select(*keys, "_copies", *out).withColumn("_copies", F.explode(F.expr("sequence(1, _copies)"))).drop("_copies")


def hex64(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def pair_hashes(w: str) -> Column:
    """Hashes of neighbouring words in the array column w (which must be a column of its own, not an expression)."""
    return F.expr(f"CASE WHEN size({w}) < 2 THEN transform({w}, x -> xxhash64(x)) ELSE transform(slice({w}, 1, size({w}) - 1), (x, i) -> xxhash64(x, {w}[i + 1])) END")


def document_fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fp0, fp1. Rows that agree in all keys must agree in their text."""
    split = df.select(*keys, words(F.col(text)).alias("w"))
    return fingerprints(split.select(*keys, pair_hashes("w").alias("hashes")), keys, "hashes", 2)


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(128.0)


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q0, q1, p0, p1, distance): for every query all fingerprints within radius, by permuted block tables.

    queries: (q0, q1), prints: (p0, p1), the halves of 128-bit fingerprints; equal ones count once, null ones take no part.
    The bits are cut into blocks. Fingerprints within the radius agree on at least `blocks - radius` whole blocks, so each
    choice of so many blocks is a table keyed by them, and a query is looked up in every table. What it meets is compared on
    all bits within the join, so only what is found leaves it.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must lie between 1 and blocks - 1")
    edges, low = [128 * i // blocks for i in range(blocks + 1)], (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(blocks), blocks - radius)]

    def tables(rows: DataFrame, x0: str, x1: str) -> DataFrame:
        part = lambda c, m: F.col(c).bitwiseAND(F.lit(signed(m)).cast("long"))
        keys = [F.xxhash64(F.lit(t), part(x0, m & low), part(x1, m >> 64)) for t, m in enumerate(chosen)]
        return rows.select(x0, x1).dropna().distinct().select(x0, x1, F.explode(F.array(*keys)).alias("key"))

    distance = F.bit_count(F.col("q0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("p1")))
    left, right = tables(queries, "q0", "q1"), tables(prints, "p0", "p1")
    met = left.join(right, (left["key"] == right["key"]) & (distance <= radius))
    return met.select("q0", "q1", "p0", "p1").distinct().withColumn("distance", distance)


def next_in_order(ids: DataFrame, group: int = 4096) -> DataFrame:
    """ids: distinct (id0, h), other columns stay. Adds next_id, next_h: the row after, in descending order; after the last, the first.

    Ids are cut into ranges at quantiles, so a task orders the ids of its range only; a range's last row takes its
    neighbour from a table of one row per range.
    """
    parts = min(RANGES, max(1, ids.count() // group))  # cuts stay a bounded literal; beyond RANGES of them ranges grow
    cuts = ids.agg(F.percentile_approx("id0", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # The number of cuts at or below an id: whole chunks of them first, then those of one chunk.
    wide = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] or [[]]
    starts = F.from_json(F.lit(json.dumps([c[0] for c in chunks[1:]])), "array<bigint>")
    upto = lambda array: F.size(F.filter(array, lambda c: c <= F.col("id0")))
    ids = ids.withColumn("chunk", upto(starts))
    ids = ids.withColumn("g", F.col("chunk") * wide + upto(F.get(F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>"), F.col("chunk")))).drop("chunk")
    order = [F.col("id0").desc(), F.col("h").desc()]
    within = Window.partitionBy("g").orderBy(*order)
    firsts = ids.groupBy("g").agg(F.max(F.struct("id0", "h")).alias("top"))
    every = Window.orderBy(F.col("g").desc())
    firsts = firsts.withColumn("after", F.lead("top").over(every)).withColumn("after", F.coalesce("after", F.first("top").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ids = ids.withColumn("nx", F.lead(F.struct("id0", "h")).over(within))
    last = ids.where("nx IS NULL").drop("nx").join(firsts.select("g", F.col("after").alias("nx")), "g")
    return ids.where("nx IS NOT NULL").unionByName(last).drop("g").select("*", F.col("nx.id0").alias("next_id"), F.col("nx.h").alias("next_h")).drop("nx")


def edited_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """(id0, h, n, rows, next_id, next_h, text, edited) per distinct id and text, which `rows` documents have; id0 is the id
    with null as the smallest number."""
    null_id = F.lit(-(1 << 63)).cast("long")
    docs = df.select(F.coalesce(F.col(key).cast("long"), null_id).alias("id0"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    ids = materialize(docs.groupBy("id0", "h", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("rows")), "edit-ids")
    pairs = materialize(next_in_order(ids), "edit-pairs")
    once = docs.withColumn("r", F.row_number().over(Window.partitionBy("id0", "h").orderBy(F.lit(0)))).where("r = 1").drop("r")
    wanted = pairs.select(F.col("id0").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("k"), F.col("next_id").alias("id0"), F.col("next_h").alias("h"))
    heads = once.join(wanted, ["id0", "h"]).select(F.col("to_id").alias("id0"), F.col("to_h").alias("h"), F.expr("left(text, k)").alias("head"))
    both = once.join(pairs, ["id0", "h"]).join(heads, ["id0", "h"])
    kept = F.expr("left(text, CAST(n - floor(n / 3) AS INT))")
    return both.select("id0", "h", "n", "rows", "next_id", "next_h", "text", F.concat(kept, "head").alias("edited"))


def near_documents(rows: DataFrame) -> DataFrame:
    """(q0, q1, near_docs): for each edited fingerprint that has any, how many documents lie within RADIUS of it."""
    prints = rows.groupBy(F.col("fp0_0").alias("p0"), F.col("fp1_0").alias("p1")).agg(F.sum("rows").alias("docs"))
    found = neighbours(rows.select(F.col("fp0_1").alias("q0"), F.col("fp1_1").alias("q1")), prints)
    return found.join(prints, ["p0", "p1"]).groupBy("q0", "q1").agg(F.sum("docs").alias("near_docs"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, their likeness, and near_docs, the number
    of documents whose fingerprint the search finds within RADIUS bits of the edited text's."""
    edited = edited_texts(table(spark, sf_dir, "documents"), "text", "doc_id")
    sides = edited.select("id0", "h", "n", "rows", "next_id", "next_h", F.sha2(F.col("edited"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    sides = sides.select("id0", "h", "n", "rows", "next_id", "next_h", "sha", F.col("x.side").alias("side"), F.col("x.t").alias("t"))
    prints = document_fingerprints(sides, ["id0", "h", "n", "rows", "next_id", "next_h", "sha", "side"], "t")
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    rows = prints.groupBy("id0", "h", "n", "rows", "next_id", "next_h", "sha").agg(*[pick(c, s) for s in (0, 1) for c in ("fp0", "fp1")])
    rows = materialize(rows, "edit-prints")
    after = rows.select(F.col("id0").alias("next_id"), F.col("h").alias("next_h"), F.col("fp0_0").alias("a"), F.col("fp1_0").alias("b"))
    near = near_documents(rows)
    own = (F.col("fp0_0"), F.col("fp1_0"))
    every = rows.join(after, ["next_id", "next_h"]).join(near, (F.col("fp0_1") == F.col("q0")) & (F.col("fp1_1") == F.col("q1")), "left")
    every = every.withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    return every.select(
        F.when(F.col("id0") != -(1 << 63), F.col("id0")).alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        F.concat(hex64("fp0_0"), hex64("fp1_0")).alias("fingerprint"), F.concat(hex64("fp0_1"), hex64("fp1_1")).alias("edited_fingerprint"),
        likeness(own, (F.col("fp0_1"), F.col("fp1_1"))).alias("near_edited"), likeness(own, (F.col("a"), F.col("b"))).alias("near_next"),
        F.coalesce("near_docs", F.lit(0)).alias("near_docs"),
    )
