"""The tool pool: bounded, per category, evicting the least quality when full; the newest always enters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL_CAP = 10


def pool_state(events: DataFrame, cap: int = POOL_CAP, category: str = "category") -> DataFrame:
    """(category, seq, quality, ...) after all additions in order of seq (unique per category).

    The state is a fold, not a window: what an addition evicts depends on those before. Additions stream through in
    order, and a task holds at most `cap` tools at a time, however many a category has.
    """
    cap = max(1, cap)
    columns = [category, "seq", "quality", *[c for c in events.columns if c not in (category, "seq", "quality")]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, schema = None, [], None
        for batch in batches:
            done, schema = [], batch.schema
            for row in batch.to_pylist():
                if row[category] != own:
                    done += held
                    own, held = row[category], []
                if len(held) >= cap:
                    held.remove(min(held, key=worth))
                held.append(row)
            yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    rows = events.select(*columns)
    return rows.repartition(category).sortWithinPartitions(category, "seq").mapInArrow(fold, rows.schema)


def worth(tool: dict) -> tuple:
    """What the tool that goes has least of: quality, then age; nulls are least of all."""
    return tool["quality"] is not None, tool["quality"] or 0.0, tool["seq"] is not None, tool["seq"] or 0


def newest(pool: DataFrame, n: int, category: str = "category") -> DataFrame:
    """The n most recently added of each category, newest first (rn); none for n = 0."""
    return pool.withColumn("rn", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("seq")))).where(F.col("rn") <= n)


def distractors(prompts: DataFrame, pool: DataFrame, n: int, seed: int, prompt: str | list[str] = "prompt_index", category: str = "category") -> DataFrame:
    """(prompt, category of the tool, seq): tools of n other categories, one of each, reproducibly at random.

    Every prompt goes through the categories in an order of its own: from a place and by a step that its hash gives, modulo
    a prime, so it meets each once. Prompts are matched on places in the list, not paired with the whole pool, which has at
    most cap rows a category.
    """
    keys = [prompt] if isinstance(prompt, str) else list(prompt)
    names = pool.select(category).distinct()
    listed = names.withColumn("pos", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), category), category)) - 1)  # one row per category
    total = listed.count()
    if total == 0 or n <= 0:
        return prompts.select(*keys, F.lit(None).cast("string").alias(category), F.lit(None).cast("long").alias("seq")).limit(0)
    prime = next(p for p in range(max(2, total), 2 * total + 2) if all(p % d for d in range(2, int(p**0.5) + 1)))
    looks = min(prime, n + 1 + prime - total)  # its own category and the places that no category has may be among them
    place, step = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(prime)), 1 + F.pmod(F.xxhash64(F.lit(seed + 1), *keys), F.lit(max(1, prime - 1)))
    draws = prompts.select(*keys, F.col(category).alias("own"), place.alias("place"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(looks - 1))).alias("k"))
    draws = draws.select(*keys, "own", "k", F.pmod(F.col("place") + F.col("k") * F.col("step"), F.lit(prime)).alias("pos"))
    sized = pool.groupBy(category).agg(F.array_sort(F.collect_list("seq")).alias("seqs"))  # at most cap numbers
    got = draws.join(listed, "pos").where(~F.col(category).eqNullSafe(F.col("own"))).join(sized, category)
    got = got.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("k"))).where(F.col("rn") <= n)
    pick = F.pmod(F.xxhash64(F.lit(seed + 2), *keys, category), F.size("seqs")).cast("int") + 1
    return got.select(*keys, category, F.element_at("seqs", pick).alias("seq"))


def admit(scored: DataFrame) -> DataFrame:
    return scored.where("score > 0 AND code IS NOT NULL AND code <> '' AND size(tools) > 0")


def counts(pool: DataFrame, category: str = "category") -> DataFrame:
    return pool.groupBy(category).agg(F.count("*").alias("n"))


def add_builds(pool: DataFrame, scored: DataFrame, order: list[str], cap: int = POOL_CAP) -> DataFrame:
    """The pool (category, seq, quality, code, tools) after the batch's admitted builds, added in order of `order`.

    Numbers go on from the greatest of each category, so a batch is one run of the same fold.
    """
    own = pool.groupBy("category").agg(F.max("seq").alias("last"))
    new = admit(scored).withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    new = new.join(own, "category", "left").select("category", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("seq"), F.col("build_eval_reward").alias("quality"), "code", "tools")
    return pool_state(pool.select("category", "seq", "quality", "code", "tools").unionByName(new), cap)


def merge_schemas(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tools of several pool entries for one prompt: the first entry with a function name gives its definition; entries that
    give none add no code. entries: (keys, pos, code, tools); keys name a prompt of a batch."""
    keys = keys or ["batch_id", "prompt_index"]
    each = entries.select(*keys, "pos", "code", F.posexplode("tools").alias("at", "tool"))
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "tool.name").orderBy("pos", "at"))).where("rn = 1")
    tools = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "tool"))), lambda x: x["tool"]).alias("tools"))
    codes = first.select(*keys, "pos", "code").distinct().groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "\n\n").alias("code"))
    return tools.join(codes, keys)


def evict_registry(sessions: DataFrame, most: int = 10_000) -> DataFrame:
    """Drops the older half (rounded down) of the registered sessions, by seq, when there are more than `most`."""
    total = sessions.count()
    if total <= most:
        return sessions
    place = F.struct("seq", "session_id")
    cut = sessions.select(place.alias("place")).orderBy("place").offset(total // 2 - 1).limit(1)  # the last one that goes
    return sessions.join(F.broadcast(cut), place > F.col("place")).drop("place")
