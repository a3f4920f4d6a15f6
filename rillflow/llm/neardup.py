"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within radius r of each other have a point in common that lies within r/2 of both. So every distinct
fingerprint emits all variants within half the radius (2,081 for 64 bits and radius 4), variants are shuffled, and
fingerprints that meet on one are linked, verified and deduplicated.

The shuffle is on the variants' first bits, and the variants of a fingerprint that share them travel as one row, which
names the fingerprint and the flips left for the other bits (22 to 37 rows instead of 2,081). The task that gets a part
makes its variants, in slices of bounded size, sorts them, and links those that meet on one to the smallest of them. So
no crowd is emitted as pairs, and no link is lost. Parts in which more than CROWD rows meet are shuffled on, by STEP more
bits at a time.

Defined results: a null text is an empty one; an empty text has fingerprint zero and is linked like any other; equal
rows are each returned and linked; a null doc_id is returned and never names a component unless it is alone in it;
an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import lower_ascii, materialize, table, words
from rillflow.llm.components import connected_components
from rillflow.llm.simhash import fingerprints, hex64

#: Variants that a task makes at once, and the table in which it finds those that may meet.
SLICE = 1 << 19
SLOT_BITS = 21
#: Variants of a part, about.
PART = 1 << 21
#: First bits that variants are shuffled on, at least; rows of a part from which on it is shuffled by STEP more.
LEAST_BITS = 6
CROWD = 1 << 19
STEP = 8


def shingle_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4) -> DataFrame:
    """(key, fp) with fp from all shingles of `width` words, repeats included; fewer words are one shingle."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("key", F.xxhash64("t").alias("uid"), words(lower_ascii(F.col("t"))).alias("w"))
    rest = ", ".join(f"w[i + {j}]" for j in range(1, width))
    hashes = f"CASE WHEN size(w) = 0 THEN array() WHEN size(w) < {width} THEN array(xxhash64(concat_ws(' ', w))) ELSE transform(slice(w, 1, size(w) - {width - 1}), (x, i) -> xxhash64(concat_ws(' ', x, {rest}))) END"
    got = fingerprints(rows.select("key", "uid", F.expr(hashes).alias("hashes")), ["key", "uid"], "hashes")
    return got.select("key", F.col("fp0").alias("fp"))


def masks(bits: int, reach: int) -> list[list[int]]:
    """By weight from 0 to reach: all numbers of so many of the lowest bits."""
    return [[sum(1 << i for i in c) for c in combinations(range(bits), r)] for r in range(reach + 1)]


def ball_size(bits: int, reach: int) -> int:
    return sum(comb(bits, r) for r in range(reach + 1))


def spread(rows: DataFrame, at: int, bits: int, reach: int) -> DataFrame:
    """(part, x, left): every x once for each way to flip at most `left` of its next `bits` bits, after the first `at`.

    part is the prefix that the variant then has, and left the flips that remain for the bits after it: so a row stands for
    all variants of x with that prefix, and fingerprints that have a variant in common meet in a part.
    """
    flips = [F.struct(F.lit(m).cast("long").alias("m"), F.lit(w).alias("w")) for w, ms in enumerate(masks(bits, reach)) for m in ms]
    ways = rows.select("part", "x", "left", F.inline(F.array(*flips))).where("w <= left")
    own = F.shiftrightunsigned("x", 64 - at - bits).bitwiseAND(F.lit((1 << bits) - 1))
    return ways.select(F.shiftleft("part", bits).bitwiseOR(own.bitwiseXOR(F.col("m"))).alias("part"), "x", (F.col("left") - F.col("w")).alias("left"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of a component of the links (a, b) to its smallest member."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[label[far]], ids[far]


def meetings(x: np.ndarray, left: np.ndarray, bits: int, reach: int, radius: int):
    """Forests (a, b) of links between fingerprints that have a variant in common, flipping at most `left` of the lowest bits.

    Variants are made and sorted in slices of bounded size: what is too much for one is split at the highest open bit. A
    slice gives a link a fingerprint at most, however many meet.
    """
    flips = [np.array(sum(masks(bits, r), []), np.uint64) for r in range(reach + 1)]
    todo = [(x, x & np.uint64((1 << bits) - 1), left, bits)]
    while todo:
        x, v, left, bits = todo.pop()
        if len(x) < 2:
            continue
        if bits and sum(int((left == r).sum()) * ball_size(bits, r) for r in range(reach + 1)) > SLICE:
            top = (v >> np.uint64(bits - 1)) & np.uint64(1)
            for side in (0, 1):
                own, other = top == side, (top != side) & (left > 0)
                todo.append((np.concatenate([x[own], x[other]]), np.concatenate([v[own], v[other]]) & np.uint64((1 << (bits - 1)) - 1), np.concatenate([left[own], left[other] - 1]), bits - 1))
            continue
        variants, origin = [], []
        for r in range(reach + 1):
            own = np.nonzero(left == r)[0]
            if len(own):
                flip = flips[r][flips[r] < np.uint64(1 << bits)] if bits < 64 else flips[r]
                variants.append((v[own, None] ^ flip[None]).ravel())
                origin.append(np.repeat(own, len(flip)))
        variants, origin = np.concatenate(variants), np.concatenate(origin)
        # Most variants are met by nobody: those whose slot of a small table is theirs alone are left before sorting.
        slot = ((variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        crowded = (np.bincount(slot, minlength=1 << SLOT_BITS) > 1)[slot]
        variants, origin = variants[crowded], origin[crowded]
        order = np.argsort(variants, kind="stable")
        variants, member = variants[order], x[origin[order]]
        if not len(variants):
            continue
        starts = np.nonzero(np.r_[True, variants[1:] != variants[:-1]])[0]
        least = np.repeat(np.minimum.reduceat(member, starts), np.diff(np.r_[starts, len(member)]))
        linked = (least != member) & (np.bitwise_count(least ^ member) <= radius)
        if linked.any():
            yield forest(least[linked], member[linked])


def ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs within radius. prints: distinct 64-bit numbers x.

    The radius must be even: two that meet are then within it by the triangle inequality, and each variant's members may be
    linked to the smallest of them alone.
    """
    if radius % 2 or not 0 < radius < 64:
        raise ValueError("the radius must be even, and less than 64")
    reach = radius // 2
    bits = max(LEAST_BITS, min(32, (prints.count() * ball_size(64, reach) // PART).bit_length()))
    tasks = max(1 << LEAST_BITS, 1 << bits >> 3)  # of some parts each: rows are small, but not the work that they stand for
    rows = materialize(spread(prints.select(F.lit(0).cast("long").alias("part"), "x", F.lit(reach).alias("left")), 0, bits, reach), "neardup-parts")

    def meet(at: int):
        def run(rows: pa.Table) -> pa.Table:
            x = rows.column("x").to_numpy().astype(np.int64).view(np.uint64)
            a, b = x[:0], x[:0]
            for more_a, more_b in meetings(x, rows.column("left").to_numpy().astype(np.int64), 64 - at, reach, radius):
                a, b = np.concatenate([a, more_a]), np.concatenate([b, more_b])
                if len(a) > SLICE:
                    a, b = forest(a, b)
            a, b = forest(a, b)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        return run

    links, at = [], bits
    while True:
        crowded = rows.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
        crowded = materialize(crowded.select("part"), "neardup-crowds")
        if at + STEP > 64 or crowded.isEmpty():
            links.append(rows.repartition(tasks, "part").groupBy("part").applyInArrow(meet(at), "a long, b long"))
            break
        calm = rows.join(crowded, "part", "left_anti")
        links.append(calm.repartition(tasks, "part").groupBy("part").applyInArrow(meet(at), "a long, b long"))
        rows = materialize(spread(rows.join(crowded, "part", "left_semi"), at, STEP, reach), "neardup-parts")
        at += STEP
    return reduce(DataFrame.unionByName, links).distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component): component is the smallest key among the documents reachable over links."""
    docs = materialize(shingle_fingerprints(df, text, key, width), "neardup-prints")
    least = materialize(docs.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "neardup-distinct")
    linked = connected_components(ball_links(least.select(F.col("fp").alias("x")), radius))
    named = linked.join(least, linked["node"] == least["fp"]).select("node", "component", "least")
    smallest = named.groupBy("component").agg(F.min("least").alias("id"))
    names = named.join(smallest, "component").select(F.col("node").alias("fp"), "id", F.lit(True).alias("linked"))
    # A document whose fingerprint nobody shares or is linked to is its own; the others look their name up in a table that
    # is dealt anew, so that Spark can split a fingerprint which many have.
    known = least.join(names, "fp", "left").where("n > 1 OR linked").select("fp", F.coalesce("id", "least").alias("component"))
    rows = docs.join(materialize(known, "neardup-names"), "fp", "left")
    return rows.select(F.col("key").alias(key), "fp", F.coalesce("component", "key").alias("component"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex64("fp").alias("fingerprint"), F.col("component").alias("component_id"))
