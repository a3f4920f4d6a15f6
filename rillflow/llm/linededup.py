"""Fuzzy line dedup by MinHash, in DataFrame functions only.

1. Texts are cut at line feeds; equal lines (after trimming and lower-casing) become one distinct line, which keeps its
   first place in order of (key, line number).
2. A distinct line's shingles are its runs of WIDTH UTF-16 units. They are exploded within generated code and reduced to
   MINIMA minima of hashes permuted by odd multipliers, each over one of SPLIT classes of shingles; the rows are
   already dealt by line, so no shuffle is added.
   A band is four of the minima; any two of the BANDS bands have at most one in common. A pair at Jaccard 0.8 agrees on a
   band with probability 0.993 (simulated with independent permutations; these odd multipliers came out alike).
   Lines of at most SHORT shingles meet exactly as well: with shingles in one order, the rarer first, two lines at the
   bound have two shingles in common among the first of both, and each two of these are a bucket (short_keys).
3. Lines that agree on a band or on two such shingles meet in a bucket. A bucket of at most NEAR + 1 lines gives all its
   pairs. In a larger one each line is compared with the bucket's hub and with the NEAR lines before it in order of
   SYMBOLS further minima, which brings the likest together; lines that share DEEP further minima with more than NEAR others (templates, edits of one line) also
   meet exactly: with shingles in one order, the rarer first, lines of n and m shingles at the bound have one in common among
   so many first ones of each as n and m ask for, and each of these with the classes of n and m is a bucket (prefix_keys),
   whose hub is the line with the least of its own. What all lines of a template share stands last and tells none apart.
   What a large bucket of either kind leaves is compared after that: all its pairs whose lines are not in one component by then,
   but for those that a bound rules out (open_pairs): the parities of a line's shingles over MARKS words of bits differ between two
   lines in no more bits than there are shingles that only one of them has (marks). So copies and edits of one line cost no
   square; lines that share a bucket and are not alike do, by a count of bits each, in cells of BLOCK by BLOCK lines.
4. Comparisons are exact: Jaccard of the shingle sets, SIMILARITY or more.
5. Components are found by star contraction on DataFrames; the line that comes first stays, all others go.

No bucket hides a link: only a pair that meets in no bucket, or in none but small bands while its symbols agree on fewer than
AGREE, is not compared.

Defined results: a null text stays null and has no lines; blank lines are kept as they are; a line shorter than WIDTH is
its own only shingle; an empty table gives an empty result; repeated rows with one key are each cleaned, and of equal
lines in them the one in the smaller line number of the smaller text hash stays; a null key comes last; other columns
are carried along, whatever their names. Lines are told apart by 64 bits, checked by 64 more: a line that shares the first
but not the second with an earlier one takes no part and stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import collect_garbage, fresh_path, materialize, table
from rillflow.llm.components import connected_components

WIDTH = 8
MINIMA = 24
#: Classes of shingles, told by other bits of their hashes; each minimum is taken over one class.
SPLIT = 4
BANDS = 14
#: A band's minima from its start on, of which all differences differ, and the step from band to band; both modulo MINIMA.
SPAN = (0, 1, 4, 9)
STEP = 7
#: Lines before it in a bucket's order that a line is compared with; up to one line more, that is all pairs of a bucket.
NEAR = 8
#: Rows of a large bucket that one cell of its remaining pairs takes from either side.
BLOCK = 1024
#: Words of 64 bits for the parities of a line's shingles.
MARKS = 16
#: Bits of each of the minima that order a bucket: two lines agree on a symbol by chance once in 16 times.
SYMBOL, SYMBOLS = 4, 16
#: Of the symbols, so many must agree before two lines of a band are compared exactly; at Jaccard 0.8 fewer do once in 3000 times.
AGREE = 7
#: Symbols that a line and more than NEAR others must share beside a band to count as a crowd.
DEEP = 4
#: Lengths within one class differ by this factor at most.
CLASS_RATIO = 1.06
#: Lines of so many shingles at most are met exactly, and the classes of hashes whose counts order their shingles.
SHORT = 19
CLASSES = 1 << 16
SIMILARITY = 0.8
#: Bytes of a unit in UTF-16, in which the k-th unit is found without a scan. A character beyond the basic plane is two.
UNIT = 2


def _normal(line: Column) -> Column:
    return F.trim(F.lower(line))


def _multipliers(n: int) -> list[int]:
    """Odd 31-bit numbers (splitmix64): h * m modulo 2^32 is a permutation of 32-bit hashes, and no product leaves 63 bits."""
    out, wrap = [], (1 << 64) - 1
    for i in range(1, n + 1):
        x = i * 0x9E3779B97F4A7C15 & wrap
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & wrap
        out.append((x ^ x >> 27) >> 33 | 1)
    return out


def lines_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, uid, pos, lid, check, line): every line that is not blank; lid and check are hashes of its normal form."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("uid"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    rows = rows.select("key", "uid", "pos", _normal(F.col("raw")).alias("line")).where("line <> ''")
    return rows.select("key", "uid", "pos", F.xxhash64("line").alias("lid"), F.xxhash64(F.lit(1), "line").alias("check"), "line")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(lid, check, first, line, n): first is the place (no key, key, uid, pos) that comes first, of n; check and line are those
    of that place."""
    place = F.struct(F.col("key").isNull().alias("no"), "key", "uid", "pos")
    least = lines.groupBy("lid").agg(F.min(F.struct(place.alias("first"), "check", "line")).alias("x"), F.count("*").alias("n"))
    return least.select("lid", "x.check", "x.first", "x.line", "n")


def bucketed(distinct: DataFrame) -> DataFrame:
    """distinct lines as a table bucketed by lid in the shared folder: grouping by lid or joining on it moves no text again.
    Lines of at most SHORT shingles lie apart, so they are read without the others."""
    spark = distinct.sparkSession
    path = fresh_path(spark, "lines-distinct")
    name = "rillflow_" + path.rsplit("-", 1)[1]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.withColumn("short", F.octet_length(F.encode("line", "UTF-16BE")) <= UNIT * (SHORT + WIDTH - 1))
    rows.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy("short").bucketBy(parts, "lid").sortBy("lid").saveAsTable(name)
    collect_garbage(spark)
    return spark.table(name)


def shingles(distinct: DataFrame) -> DataFrame:
    """(lid, h): a hash of each shingle, repeats included."""
    wide = distinct.select("lid", F.encode("line", "UTF-16BE").alias("u"))
    each = wide.select("lid", "u", F.explode(F.expr(f"sequence(0, greatest(1, octet_length(u) DIV {UNIT} - {WIDTH - 1}) - 1)")).alias("i"))
    return each.select("lid", F.xxhash64(F.expr(f"substring(u, {UNIT} * i + 1, {UNIT * WIDTH})")).alias("h"))


def bands(distinct: DataFrame) -> DataFrame:
    """(lid, bucket, rank) of distinct lines, a row for each band. rank is SYMBOLS symbols of the minima, begun at another one in
    each band: of lines in order of it, neighbours agree on the most minima in that order."""
    low = (1 << 32) - 1
    each = shingles(distinct).select("lid", F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(SPLIT - 1)).alias("c"), F.col("h").bitwiseAND(F.lit(low)).alias("h"))
    each = each.groupBy("lid", "c").agg(*[F.min((F.col("h") * F.lit(m).cast("long")).bitwiseAND(F.lit(low))).alias(f"p{i}") for i, m in enumerate(_multipliers(MINIMA // SPLIT))])
    # A class without shingles gives minima of -1, in which two lines without them agree.
    least = each.groupBy("lid").agg(*[F.coalesce(F.max(F.when(F.col("c") == j % SPLIT, F.col(f"p{j // SPLIT}"))), F.lit(-1)).alias(f"m{j}") for j in range(MINIMA)])
    symbols = F.lit(0).cast("long")
    for j in range(SYMBOLS):
        symbols = symbols.bitwiseOR(F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit((1 << SYMBOL) - 1)), SYMBOL * j))
    least = least.withColumn("symbols", symbols)
    keys = []
    for b in range(BANDS):
        turn = SYMBOL * (5 * b % SYMBOLS)
        rank = F.shiftleft("symbols", turn).bitwiseOR(F.shiftrightunsigned("symbols", 64 - turn)) if turn else F.col("symbols")
        keys.append(F.struct(F.xxhash64(F.lit(b), *[F.col(f"m{(STEP * b + k) % MINIMA}") for k in SPAN]).alias("bucket"), rank.alias("rank")))
    return least.select("lid", F.inline(F.array(*keys)))


def ordered_sets(lines: DataFrame) -> DataFrame:
    """(lid, s, common): each line's distinct shingles, the rarer of these lines' first, and how often its rarest occurs. Counts are kept for CLASSES classes of hashes, so
    the table of them is bounded."""
    each = shingles(lines).withColumn("c", F.col("h").bitwiseAND(F.lit(CLASSES - 1)))
    counts = materialize(each.groupBy("c").agg(F.count("*").alias("n")), "lines-classes")
    sets = each.join(F.broadcast(counts), "c").groupBy("lid").agg(F.sort_array(F.collect_set(F.struct("n", "h"))).alias("s"))  # at most CLASSES rows
    return sets.select("lid", F.expr("transform(s, x -> x.h)").alias("s"), F.expr("s[0].n").alias("common"))


def short_keys(distinct: DataFrame, similarity: float) -> DataFrame:
    """(lid, bucket) of the lines of at most SHORT shingles, such that any two of them at the bound share a bucket.

    A set of n shingles shares at least o = ceil(similarity * n) with any set at the bound. In one order of all shingles the
    first two that both have are among the first n - o + 2 of either; only where o is 1 or 2 may they have one alone, which
    is among the first n - o + 1. Any order is right; rare ones first keep buckets small.
    """
    short = distinct.where(F.col("short") if "short" in distinct.columns else f"octet_length(encode(line, 'UTF-16BE')) <= {UNIT * (SHORT + WIDTH - 1)}")
    sets = ordered_sets(short).withColumn("o", F.expr(f"CAST(ceil({similarity}D * size(s) - 1e-9D) AS INT)"))
    first = lambda more: f"slice(s, 1, least(size(s), size(s) - o + {more}))"
    twos = f"flatten(transform(array({first(2)}), w -> flatten(transform(w, (x, i) -> transform(slice(w, i + 2, size(w)), y -> xxhash64(-1, x, y))))))"
    ones = f"IF(o <= 2, transform({first(1)}, x -> xxhash64(-2, x)), array())"
    return sets.select("lid", F.explode(F.expr(f"concat({twos}, {ones})")).alias("bucket"))


def prefix_keys(lines: DataFrame, similarity: float) -> DataFrame:
    """(lid, bucket, rank, centre) of lines, such that any two at the bound share a bucket.

    Sets of n and m shingles at the bound share at least o = ceil(similarity (n + m) / (1 + similarity)), so in one order of
    all shingles they have one in common among the first n - o + 1 and m - o + 1. A bucket is such a shingle with the classes
    of both lengths: a set takes part once for each class of lengths that a partner may have, with as many shingles as the
    least length of that class asks for. That is fewer than a prefix for partners of any length has, and leaves out what
    all lines of a template share, where these lengths allow no partner without a rarer shingle in common. rank is of the
    two shingles that follow; centre is greatest for the line with the commonest rarest shingle, which has the least of its own.
    """
    size_class = lambda n: f"CAST(floor(ln({n}) / {math.log(CLASS_RATIO)!r}D + 1e-9D) AS INT)"
    sets = ordered_sets(lines).withColumn("n", F.size("s"))
    least = f"greatest(1, CAST(ceil({similarity}D * n - 1e-9D) AS INT))"
    sets = sets.withColumn("own", F.expr(size_class("n"))).withColumn("other", F.explode(F.expr(f"sequence({size_class(least)}, {size_class(f'n / {similarity}D')})")))
    sets = sets.withColumn("m", F.expr(f"greatest({least}, CAST(ceil(pow({CLASS_RATIO}D, other) - 1e-6D) AS INT))"))
    sets = sets.withColumn("p", F.expr(f"least(n, greatest(1, n + 1 - CAST(ceil({similarity}D * (n + m) / {1 + similarity}D - 1e-9D) AS INT)))"))
    low = (1 << 32) - 1
    rank = f"coalesce(get(s, i + 1), 0) << 32 | (coalesce(get(s, i + 2), 0) & {low}L)"
    keys = f"transform(slice(s, 1, p), (x, i) -> named_struct('bucket', xxhash64(-3, x, least(own, other), greatest(own, other)), 'rank', {rank}))"
    # The hash below the count tells lines of equal counts apart.
    centre = F.shiftleft(F.least("common", F.lit(1 << 20)), 42).bitwiseOR(F.shiftrightunsigned(F.xxhash64("lid"), 22))
    return sets.select("lid", centre.alias("centre"), F.explode(F.expr(keys)).alias("k")).select("lid", "k.bucket", "k.rank", "centre")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, rank, lid, n, hub, hub_rank): rows of buckets that several lines share, with the bucket's size and its line of the
    greatest `centre` (by default the greatest rank).

    Rows are dealt by bucket once; the aggregate and the join read the same shuffle, and both stream: no task sorts or
    holds a bucket.
    """
    centre = "centre" if "centre" in rows.columns else "rank"
    dealt = rows.repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.max_by("lid", centre).alias("hub"), F.max_by("rank", centre).alias("hub_rank")).where("n > 1")
    return dealt.join(sizes.hint("shuffle_hash"), "bucket").select("bucket", "rank", "lid", "n", "hub", "hub_rank")


def unlike_buckets(rows: DataFrame) -> DataFrame:
    """rows of one of the buckets that hold the same lines: the others give the same pairs. A bucket is told by 128 bits of its lines."""
    told = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "lid")).alias("y"))
    one = told.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(one, "bucket", "left_semi")


def _agree(a: Column, b: Column) -> Column:
    """How many symbols of two ranks agree."""
    x = a.bitwiseXOR(b)
    any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.lit(SYMBOLS) - F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << SYMBOL * i for i in range(SYMBOLS)))))


def bucket_pairs(met: DataFrame, agree: int = 0) -> DataFrame:
    """(a, b), a < b, some of them several times: pairs of lines to compare, from the rows of shared_buckets: all pairs of a bucket
    of at most NEAR + 1 rows; of a larger one, each line with its hub and with the NEAR before it in order of rank. That order is
    dealt by ranges, so a large bucket lies in several tasks; where one ends, the order begins anew. Pairs whose ranks agree on
    fewer than `agree` symbols are left out."""
    small, large = met.where(F.col("n") <= NEAR + 1), met.where(F.col("n") > NEAR + 1)
    before = Window.partitionBy("bucket").orderBy("lid").rowsBetween(-NEAR, -1)
    near = small.select("lid", "rank", F.collect_list(F.struct("lid", "rank")).over(before).alias("xs")).select("lid", "rank", F.explode("xs").alias("x"))
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = large.repartitionByRange(parts, "bucket", "rank", "lid").withColumn("range", F.spark_partition_id())
    before = Window.partitionBy("range").orderBy("bucket", "rank", "lid").rowsBetween(-NEAR, -1)
    own = ranged.select("bucket", "lid", "rank", F.collect_list(F.struct("bucket", "lid", "rank")).over(before).alias("xs"))
    own = own.select("bucket", "lid", "rank", F.explode("xs").alias("x")).where("x.bucket = bucket").select("lid", "rank", F.struct("x.lid", "x.rank").alias("x"))
    first = large.select("lid", "rank", F.struct(F.col("hub").alias("lid"), F.col("hub_rank").alias("rank")).alias("x"))
    pairs = near.union(own).union(first).where(F.col("lid") != F.col("x.lid"))
    if agree:
        pairs = pairs.where(_agree(F.col("rank"), F.col("x.rank")) >= agree)
    return pairs.select(F.least("lid", "x.lid").alias("a"), F.greatest("lid", "x.lid").alias("b"))


def shingle_set(text: str) -> str:
    """SQL for the hashes of a text's shingles, repeats included. The text is bound to a variable, so that it is not read
    from its row, and copied, for each shingle."""
    return (
        f"element_at(transform(array({text}), y -> transform(sequence(1, greatest(1, octet_length(y) - {UNIT * WIDTH - 1}), {UNIT}), "
        f"i -> xxhash64(substring(y, i, {UNIT * WIDTH})))), 1)"
    )


def similar_pairs(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose Jaccard reaches similarity, found exactly. n_a and n_b are the sizes of both sets, if known."""
    known = [x for x in ("n_a", "n_b") if x in pairs.columns]
    left = distinct.select(F.col("lid").alias("a"), F.col("line").alias("la"))
    right = distinct.select(F.col("lid").alias("b"), F.col("line").alias("lb"))
    # The pairs, two numbers a row, are hashed, so that the lines need no sort.
    texts = pairs.hint("shuffle_hash").join(left, "a").join(right, "b").select("a", "b", *known, F.encode("la", "UTF-16BE").alias("u"), F.encode("lb", "UTF-16BE").alias("v"))
    # The generator computes both sets once; a projection would be merged into the condition and computed again.
    sets = texts.select("a", "b", *known, F.expr(f"inline(array(named_struct('s', {shingle_set('u')}, 't', {shingle_set('v')})))"))
    either = "(n_a + n_b - size(array_intersect(s, t)))" if known else "size(array_union(s, t))"
    return sets.where(f"size(array_intersect(s, t)) >= {similarity - 1e-9!r}D * {either}").select("a", "b")


def crowded(met: DataFrame) -> DataFrame:
    """(lid): lines that share DEEP symbols of the rank with more than NEAR others of a bucket, so that the order may hide a link.
    Lines that met by chance part within a few symbols."""
    deep = F.shiftrightunsigned("rank", SYMBOL * (SYMBOLS - DEEP)).alias("deep")
    dense = met.where(F.col("n") > NEAR + 1).select("bucket", deep, "lid")
    heads = dense.groupBy("bucket", "deep").agg(F.count("*").alias("n")).where(F.col("n") > NEAR + 1)
    return dense.join(heads, ["bucket", "deep"], "left_semi").select("lid").distinct()


def marks(lines: DataFrame) -> DataFrame:
    """(lid, n, p0, p1, ...) of lines: how many distinct shingles each has, and of each of 64 * MARKS classes of shingles whether
    their number is odd. A shingle that two lines share changes the same bit of both, so their bits differ in no more places than
    there are shingles that only one of them has."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = lines.repartition(parts, "lid").select("lid", F.encode("line", "UTF-16BE").alias("u"))  # lines are dealt, not shingles
    each = wide.select("lid", F.explode(F.expr(f"array_distinct({shingle_set('u')})")).alias("h"))
    each = each.groupBy("lid", F.expr(f"shiftrightunsigned(h, 6) & {MARKS - 1}").alias("w")).agg(F.count("*").alias("n"), F.expr("bit_xor(shiftleft(1L, CAST(h & 63 AS INT)))").alias("p"))
    words = [F.coalesce(F.max(F.when(F.col("w") == k, F.col("p"))), F.lit(0)).alias(f"p{k}") for k in range(MARKS)]
    return each.groupBy("lid").agg(F.sum("n").alias("n"), *words)


def may_reach(similarity: float) -> Column:
    """Whether lines with the marks n_a, p0_a, ... and n_b, p0_b, ... may be alike. Sets of n and m shingles at the bound have at
    most (1 - similarity) / (1 + similarity) (n + m) that only one of them has; no such pair is ruled out."""
    apart = F.lit(0)
    for k in range(MARKS):
        apart = apart + F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b")))
    least = F.greatest(apart.cast("long"), F.abs(F.col("n_a") - F.col("n_b")))
    return least <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)


def likely_pairs(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n_a, n_b): those of the pairs (a, b) that may be alike by the marks of both."""
    for end in ("a", "b"):
        pairs = pairs.join(marked.select(F.col("lid").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in marked.columns if x != "lid"]), end)
    return pairs.where(may_reach(similarity)).select("a", "b", "n_a", "n_b")


def first_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs, each line's with the least other: they link most of what all of them link."""
    ends = pairs.select(F.explode(F.array(F.struct("a", F.col("b").alias("o")), F.struct(F.col("b").alias("a"), F.col("a").alias("o")))).alias("x"))
    least = ends.groupBy("x.a").agg(F.min("x.o").alias("o"))
    return pairs.join(least.select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b")).distinct(), ["a", "b"], "left_semi")


def between(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Those of the pairs whose lines are not in one component (node, component) yet."""
    for end in ("a", "b"):
        pairs = pairs.join(linked.select(F.col("node").alias(end), F.col("component").alias("c" + end)), end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def line_components(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of distinct lines (lid, line) that are linked to another."""
    agree = AGREE if similarity >= SIMILARITY else 0
    short = short_keys(distinct, similarity).withColumn("rank", F.lit(0).cast("long"))
    met = materialize(shared_buckets(bands(distinct).unionByName(short)), "lines-met")
    crowd = materialize(crowded(met), "lines-crowd")
    # Only lines that met another are read from here on.
    few = materialize(distinct.join(met.select("lid").union(crowd.select("lid")).distinct(), "lid", "left_semi").select("lid", "line"), "lines-few")
    keys = materialize(prefix_keys(few.join(crowd, "lid", "left_semi"), similarity), "lines-keys")
    again = materialize(shared_buckets(unlike_buckets(keys)), "lines-met")
    marked = materialize(marks(few), "lines-marks")
    pairs = bucket_pairs(met, agree).union(bucket_pairs(again)).distinct()
    pairs = materialize(likely_pairs(pairs, marked, similarity), "lines-pairs")
    linked = materialize(connected_components(similar_pairs(first_pairs(pairs), few, similarity)), "lines-linked")
    linked = after(linked, materialize(similar_pairs(materialize(between(pairs, linked), "lines-rest"), few, similarity), "lines-more"))
    left = open_pairs(met.union(again), linked, few, similarity, marked)
    for end in ("a", "b"):
        left = left.join(marked.select(F.col("lid").alias(end), F.col("n").alias("n_" + end)), end)
    left = materialize(left.select("a", "b", "n_a", "n_b"), "lines-left")
    return after(linked, materialize(similar_pairs(left, few, similarity), "lines-more"))


def after(linked: DataFrame, more: DataFrame) -> DataFrame:
    """linked (node, component) with the links (a, b) more, if there are any; written, where it changes."""
    return linked if more.isEmpty() else materialize(joined(linked, more), "lines-linked")


def joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """linked (node, component) after links (a, b) more: their components are linked, not all nodes anew."""
    of = linked.select(F.col("node").alias("lid"), "component")
    ends = more
    for end in ("a", "b"):
        ends = ends.join(of.withColumnRenamed("lid", end).withColumnRenamed("component", "c" + end), end, "left")
    ends = materialize(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "lines-ends")
    over = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("least"))
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x"))
    nodes = linked.select("node", "component").union(new.select("x.*").where("node = component")).distinct()
    return nodes.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def open_pairs(met: DataFrame, linked: DataFrame, distinct: DataFrame | None = None, similarity: float = SIMILARITY, marked: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: of the buckets of more than NEAR + 1 rows, all pairs whose lines are not in one component (node, component)
    yet; with `distinct` given, those of them that may be alike by their marks. A bucket of one component has none. The others are
    cut into blocks of about BLOCK rows, and each two blocks are a cell of their own, so that a bucket's pairs are found in many
    tasks."""
    known = linked.select(F.col("node").alias("lid"), "component")
    rows = met.where(F.col("n") > NEAR + 1).select("bucket", "lid").join(known, "lid", "left")
    rows = materialize(rows.select("bucket", "lid", F.coalesce("component", "lid").alias("c")), "lines-open")
    mixed = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    rows = rows.join(mixed.select("bucket", "blocks"), "bucket").withColumn("own", F.pmod(F.xxhash64("lid"), F.col("blocks")))
    own = ["lid", "c"]
    if distinct is not None:
        rows = materialize(rows, "lines-open")
        if marked is None:
            marked = materialize(marks(distinct.join(rows.select("lid").distinct(), "lid", "left_semi")), "lines-marks")
        rows = rows.join(marked, "lid")
        own += ["n", *[f"p{k}" for k in range(MARKS)]]
    left = rows.select("bucket", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), *[F.col(x).alias(x + "_a") for x in own])
    right = rows.select("bucket", F.explode(F.expr("sequence(0L, own)")).alias("i"), F.col("own").alias("j"), *[F.col(x).alias(x + "_b") for x in own])
    left, right = left.alias("x"), right.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    apart = (F.col("c_a") != F.col("c_b")) & ((F.col("x.i") != F.col("x.j")) | (F.col("lid_a") < F.col("lid_b")))
    if distinct is not None:
        apart = apart & may_reach(similarity)
    return left.join(right, same & apart).select(F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b")).distinct()


def line_classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, uid, pos, keep, first): every line that is not blank, whether it stays, and the place of the line that stays for it."""
    lines = lines_of(df, text, key)
    distinct = bucketed(distinct_lines(lines))
    linked = line_components(distinct, similarity)
    firsts = distinct.select("lid", "check", "first", "n")
    named = firsts.join(linked.withColumnRenamed("node", "lid"), "lid").select("lid", "component", "first")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    heads = named.join(heads, "component").select("lid", "head")
    # Lines that occur once and are linked to none stay; only the others are looked up, in a table that is dealt anew, so
    # that Spark can split a line which many rows have.
    known = firsts.join(heads, "lid", "left").where("n > 1 OR head IS NOT NULL")
    known = materialize(known.select("lid", F.col("check").alias("known"), F.coalesce("head", "first").alias("head")), "lines-known")
    rows = lines.select("key", "uid", "pos", "lid", "check").join(known, "lid", "left")
    own = F.struct(F.col("key").isNull().alias("no"), "key", "uid", "pos")
    first = F.when(F.col("check") == F.col("known"), F.col("head")).otherwise(own)
    return rows.select("key", "uid", "pos", (first == own).alias("keep"), first.alias("first"))


def dropped_lines(classes: DataFrame) -> DataFrame:
    """(key, uid, n_lines, dropped): per text, its lines that are not blank and the sorted numbers of those that go."""
    return classes.groupBy("key", "uid").agg(F.size(F.collect_set("pos")).alias("n_lines"), F.array_sort(F.collect_set(F.when(~F.col("keep"), F.col("pos")))).alias("dropped"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """df with its lines deduplicated in `text`; every row stays, if with an empty text."""
    gone = dropped_lines(line_classes(df, text, key, similarity)).where("size(dropped) > 0").select("key", "uid", "dropped")
    # The caller's columns travel in one struct, so none of their names can clash.
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    rows = rows.join(gone, rows["id"].eqNullSafe(gone["key"]) & (rows["hash"] == gone["uid"]), "left")
    cut = F.array_join(F.filter(F.split(F.col("row")[text], "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    clean = F.when(F.col("dropped").isNull(), F.col("row")[text]).otherwise(cut)
    return rows.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in df.columns])


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, lines kept, and the numbers (from 0) of the lines that go."""
    docs = table(spark, sf_dir, "documents")
    per = dropped_lines(line_classes(docs))
    ids = docs.select("doc_id", F.xxhash64("text").alias("u"))
    rows = ids.join(per, ids["doc_id"].eqNullSafe(per["key"]) & (ids["u"] == per["uid"]), "left")
    empty = F.array().cast("array<int>")
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), (F.coalesce("n_lines", F.lit(0)) - F.coalesce(F.size("dropped"), F.lit(0))).cast("long").alias("n_kept"), F.coalesce("dropped", empty).alias("dropped"))
