"""The tool pool as keyed state of a stream: a category's tools with their code, kept across batches and restarts.

A stream of additions (category, batch, pos, quality, code, tools, cap) is folded by category. The state of a category is a
list of its tools and a value with the last batch, the greatest number given and counts of what came and went. A batch
brings its own cap; an addition to a full category first evicts the tool of least quality (of equals the oldest), as the batch
fold in operators.pool does. Additions are numbered in order of (batch, pos); a batch that the state has seen is not added
again, so a source that repeats files after a failure changes nothing.

State lies in RocksDB, in Avro, so fields may be added to a tool: tools written before have null there. Between runs the
pool is read from the checkpoint by Spark's state reader; nothing of it passes through the driver.

A task holds the tools of one category (at most the greatest cap) and its additions of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from rillflow.functions.jsonx import TOOLS
from rillflow.operators.pool import POOL_CAP

TOOL = f"seq long, quality double, code string, tools {TOOLS.simpleString()}"
SEEN = "batch long, last long, added long, evicted long"
ADDITION = f"category string, batch long, pos long, quality double, code string, tools {TOOLS.simpleString()}, cap int"
#: Fixed values of Spark's settings for this kind of state.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.encodingFormat": "avro"}


def _plain(value: object) -> object:
    """Nested rows and structs as tuples, as the state takes them."""
    if isinstance(value, dict):
        value = tuple(value.values())
    if isinstance(value, (list, tuple)):
        return (list if isinstance(value, list) else tuple)(_plain(v) for v in value)
    return value


class PoolKeeper(StatefulProcessor):
    """tool: the schema of a tool in the state; its first three fields are those of TOOL. Other fields come from additions."""

    def __init__(self, cap: int = POOL_CAP, tool: str = TOOL) -> None:
        self.cap, self.tool = cap, tool
        self.fields = StructType.fromDDL(tool).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tools = handle.getListState("tools", self.tool)
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = [_plain(t) for t in self.tools.get()]
        batch, last, added, evicted = self.seen.get() if self.seen.exists() else (None, 0, 0, 0)
        new = sorted((r for r in rows if batch is None or r["batch"] > batch), key=lambda r: (r["batch"], r["pos"]))
        for r in new:
            if len(held) >= max(1, self.cap if r["cap"] is None else r["cap"]):
                held.remove(min(held, key=lambda t: (t[1] is not None, t[1] or 0.0, t[0])))
                evicted += 1
            last, added, batch = last + 1, added + 1, r["batch"]
            held.append((last, *(_plain(r[f]) for f in self.fields[1:])))
        if new:
            self.tools.put(held)
            self.seen.update((batch, last, added, evicted))
        for tool in held:
            yield Row(category=key[0], **dict(zip(self.fields, tool, strict=True)), kept=len(held), added=added, evicted=evicted)

    def close(self) -> None:
        pass


@contextmanager
def state_settings(spark: SparkSession):
    """The session's settings while a query starts; a running query keeps those it began with."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pool_changes(additions: DataFrame, cap: int = POOL_CAP, tool: str = TOOL) -> DataFrame:
    """Per micro-batch, the pools of the categories that it touches: (category, tool's fields, kept, added, evicted)."""
    out = f"category string, {tool}, kept long, added long, evicted long"
    return additions.groupBy("category").transformWithState(PoolKeeper(cap, tool), out, "update", "None")


def additions_of(spark: SparkSession, path: str, schema: str = ADDITION, files: int | None = None) -> DataFrame:
    """A folder of Parquet files of additions as a stream, so many files a micro-batch."""
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (read.option("maxFilesPerTrigger", files) if files else read).parquet(path)


def keep_pool(additions: DataFrame, checkpoint: str, changes: str, cap: int = POOL_CAP, tool: str = TOOL) -> StreamingQuery:
    """Folds all additions there are into the state at `checkpoint`, and appends the touched pools to the table at `changes`."""
    spark = additions.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    with state_settings(spark):
        return pool_changes(additions, cap, tool).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def pool_snapshot(spark: SparkSession, checkpoint: str, tool: str = TOOL) -> DataFrame:
    """(category, tool's fields): the pool as the last finished micro-batch left it; empty before the first."""
    fields = StructType.fromDDL(tool).names
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"category string, {tool}")
    with state_settings(spark):
        state = spark.read.format("statestore").option("stateVarName", "tools").option("flattenCollectionTypes", "true").load(checkpoint)
    return state.select(F.col("key.category").alias("category"), *[F.col("list_element")[f].alias(f) for f in fields])
