"""Where a rollout's turns are written: the shared folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN: dict[str, list[str]] = {}


def batch_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a session of one JVM (tests) may go without: it gets a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/rollout-{uuid.uuid4().hex}"
    _OWN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the folders that this application was given; call it when results that read them are no longer needed."""
    paths, jvm = _OWN.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
