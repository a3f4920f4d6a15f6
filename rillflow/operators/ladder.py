"""Word ladders: shortest ways from word to word, one letter at a time, by breadth-first levels over a table of words.

Two words are neighbours if they agree on a pattern, a word with one letter left out; so words meet on patterns, and no pair
of unlike words is ever made. A level is a join of the words reached last with the patterns, less the words reached before;
all starts go on together, and a start whose targets are all reached goes no further. Levels are written, so that a lost
executor costs no earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import _col
from rillflow.sources.replay import batch_folder


def patterns(word: Column | str) -> Column:
    """The word with each of its letters left out in turn, as array<struct<at, rest>>."""
    w = _col(word)
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(i.alias("at"), F.concat(F.substring(w, F.lit(1), i - 1), F.lit("\0"), F.substring(w, i + 1, F.length(w))).alias("rest")))


def by_pattern(words: DataFrame, word: str = "word") -> DataFrame:
    """(pattern, word) of distinct words that are not empty."""
    rows = words.select(F.col(word).alias("word")).where("word <> ''").distinct()
    return rows.select("word", F.explode(patterns("word")).alias("p")).select(F.col("p.rest").alias("pattern"), "word")


def shortest_ladders(puzzles: DataFrame, words: DataFrame, most: int = 10, word: str = "word", folder: str | None = None) -> DataFrame:
    """puzzles (start, target), each once, with steps and ladder: of the shortest ways over `words` (the target is one of them, the
    start may be any) that first in order of its words; null where there is none of at most `most` steps. A null start or
    target has none; a start that is its own target is a ladder of 0 steps if it is a word.
    """
    spark = puzzles.sparkSession
    folder = folder or batch_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(path)

    asked = written(puzzles.select("start", "target").distinct(), "puzzles")
    edges = written(by_pattern(words, word), "patterns")
    known = edges.select(F.col("word").alias("target")).distinct()
    reached = asked.where("start IS NOT NULL").select("start", F.col("start").alias("word"), F.lit(0).alias("steps"), F.array("start").alias("ladder")).distinct()
    reached = last = written(reached, "level-0")
    solved = written(asked.where("start = target").join(known, "target", "left_semi").select("start", "target", F.lit(0).alias("steps"), F.array("start").alias("ladder")), "solved-0")
    open_ = asked.where("start <> target AND length(start) = length(target)").join(known, "target", "left_semi")
    for step in range(1, most + 1):
        open_ = written(open_.join(solved.select("start", "target"), ["start", "target"], "left_anti"), f"open-{step}")
        if open_.isEmpty():
            break
        going = last.join(open_.select("start").distinct(), "start", "left_semi").withColumnRenamed("word", "before")
        going = going.select("start", "ladder", F.explode(patterns("before")).alias("p")).select("start", "ladder", F.col("p.rest").alias("pattern"))
        found = going.join(edges, "pattern").groupBy("start", "word").agg(F.min("ladder").alias("ladder"))
        found = found.join(reached.select("start", "word"), ["start", "word"], "left_anti")
        last = written(found.select("start", "word", F.lit(step).alias("steps"), F.array_append("ladder", F.col("word")).alias("ladder")), f"level-{step}")
        reached = reached.unionByName(last)
        solved = written(solved.unionByName(last.join(open_, (last["word"] == open_["target"]) & (last["start"] == open_["start"]), "left_semi").select("start", F.col("word").alias("target"), "steps", "ladder")), f"solved-{step}")
        if last.isEmpty():
            break
    out = asked.join(solved.withColumnsRenamed({"start": "_s", "target": "_t"}), F.col("start").eqNullSafe(F.col("_s")) & F.col("target").eqNullSafe(F.col("_t")), "left")
    return out.select("start", "target", "steps", "ladder")
