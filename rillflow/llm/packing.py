"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

1. Each document becomes its token ids and an end id; a longer one is cut into pieces of full capacity and a rest.
2. The histogram of piece lengths (at most `capacity` rows) goes to the driver, which plans best-fit decreasing over
   counts: a step puts c pieces of one length into c alike sequences at once. The plan's size is bounded by the
   capacity, not by the corpus.
3. Every piece gets a rank within its length, and takes the slot that the plan gives to that rank.

Ranks are found without a task that sees a whole length: a length's pieces are dealt to groups of about RANK_GROUP rows,
and groups are offset by the counts of those before.

Defined results: a null text is an empty one and packs as its end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, spread, table

RANK_GROUP = 1024
#: Words whose ids a Python worker remembers before it starts afresh; twice as many pre-tokens.
CACHE_WORDS = 400_000
_LOADED: dict[str, WordIds] = {}


class WordIds:
    """Ids of blank-separated words as little-endian 32-bit bytes.

    The tokenizer drops white space and none of its tokens spans it, so the ids of a text are those of its words in turn.
    A word of Latin letters, which its normalizer only lower-cases, is the ids of its pre-tokens in turn; words differ far
    more than pre-tokens do, and only pre-tokens not seen before reach the tokenizer, all in one text.
    """

    #: Fixed value: the tokenizer's own pre-tokenization.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.words: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        # Where a text holds one of these strings, the tokenizer cuts it there; such a text goes to it whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.split = regex.compile(self.PIECES).findall
        self.plain = regex.compile("[\x21-\u024f]+").fullmatch

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of words."""
        cut = {w: self.split(w.lower()) for w in new if self.plain(w)}
        fresh = list({p for ps in cut.values() for p in ps}.difference(self.known))
        if fresh:
            ids = self.direct(" ".join(fresh))
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) == len(fresh):
                data = ids.tobytes()
                self.known.update((p, data[4 * i : 4 * j]) for p, i, j in zip(fresh, [0, *stops[:-1].tolist()], stops.tolist(), strict=True))
            else:
                self.known.update((p, self.direct(p).tobytes()) for p in fresh)
        for w in new:
            self.words[w] = b"".join(map(self.known.__getitem__, cut[w])) if w in cut else self.direct(w).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.direct(text).tobytes()
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        if len(self.known) > 2 * CACHE_WORDS:
            self.known = {}
        new = list(set(parts).difference(self.words))
        if new:
            self.learn(new)
        return b"".join(map(self.words.__getitem__, parts))


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(df: DataFrame, text: str, key: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32, n): the rows to be packed. Token ids are not kept; n numbers a task's rows, so
    that equal rows can be dealt to several."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made = word_ids(tokenizer), 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row_key, value in zip(batch.column(0), batch.column(1), strict=True):
                data = ids.encode(value.as_py() or "") + end
                row_key = row_key.as_py()
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, x in zip(out, (row_key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            out.append(list(range(made, made + len(out[0]))))
            made += len(out[0])
            yield pa.record_batch([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["key", "piece", "start", "length", "ids_crc32", "n"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, n long")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order of length and rank.

    Ranks from one row's first to the next row's go to as many sequences from its first on, all at that offset. Open
    sequences are kept by free room as runs of numbers, so a step costs the same for one sequence as for a billion.
    """
    plan: list[tuple[int, int, int, int]] = []
    rooms: list[int] = []  # sorted; those with open runs
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # best fit fills a fresh sequence with this length first
                room, first, count = capacity, opened, -(-left // each)
                opened += count
            else:
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            used = min(left, count)
            plan.append((length, rank, first, capacity - room))
            put(room - length, first, used)
            if used < count:
                put(room, first + used, count - used)
            left, rank = left - used, rank + used
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 4)


def pack(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    tokenizer: str | None = None,
    capacity: int = 4096,
    end_id: int = 1,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = df.sparkSession
    rows = materialize(pieces(df, text, key, tokenizer, capacity, end_id), "pack-pieces")
    lengths = materialize(rows.groupBy("length").agg(F.count("*").alias("n")), "pack-lengths")  # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    plan = best_fit_plan(histogram, capacity)
    sent = spark.sparkContext.broadcast(plan)

    groups = lengths.select("length", F.ceil(F.col("n") / RANK_GROUP).alias("groups"))
    rows = rows.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("key", "piece", "ids_crc32", "n"), F.col("groups"))).drop("groups")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("key", "piece", "start", "ids_crc32", "n")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "part"])
    ranked = ranked.select("key", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        keys = p[:, 0] << 44 | p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(p[at, 2] + rank - p[at, 1], pa.int64()), pa.array(p[at, 3], pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = rows.schema["key"].dataType.simpleString()
    return ranked.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
