"""What the corpus operators share: the shared folder, written tables, keys for rows and ASCII rules for words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, list[str]] = {}


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies beside the driver's program."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of a table, dealt out over all cores before Python work where its files make fewer partitions than that (small
    tables of one row group); large tables are read as they lie. Only for plain scans: their plan runs no job."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows, without a copy: what Python makes of a piece's texts then stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one JVM (tests) may go without: it
    gets a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/rillflow/{label}-{uuid.uuid4().hex}"
    _OWN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver has collected what refers to them."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application's operators wrote; call it when their results are no longer needed."""
    paths = _OWN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if "/lines-distinct-" in path:
            spark.sql(f"DROP TABLE IF EXISTS rillflow_{path.rpartition('-')[2]}")
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the faster function, which does the same to them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
