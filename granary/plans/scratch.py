"""Written intermediate tables under the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends. Without that setting, one machine's temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/granary/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made[path] = spark
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once, so that all later reads see the same rows."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have gone before this handler
            return
