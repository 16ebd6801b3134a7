"""Shared plumbing of the training-data operators: scratch tables, row keys, packed literals."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separator of words in this subpackage.
WORD = "[^\\x20\\x09-\\x0D]+"

_made: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, from ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is set, but only in local mode: on a
    cluster a machine-local folder would be invisible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/granary/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made[path] = spark
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.pop(path, None)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            discard(spark, path)
        except Exception:  # the JVM may have gone before this handler
            return


#: Whether Spark deletes a query's shuffle files when the query ends, and not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files; the session's setting is put back."""
    old = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, old)


class Scratch:
    """Written intermediate tables of one operator call; ``drop`` frees those no longer needed.

    A table written to the shared folder cuts lineage in a way that survives lost executors;
    the shuffles that made it are deleted as soon as it is written.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.tag}-{name}")
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        discard(self.spark, *(self.paths.pop(n) for n in names if n in self.paths))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table as a JVM-side literal: no RDD, no Arrow, no Python worker."""
    fields = T._parse_datatype_string(schema)
    data = json.dumps([dict(zip(fields.names, r, strict=True)) for r in rows])
    parsed = F.from_json(F.lit(data), T.ArrayType(fields))
    return spark.range(1).select(F.inline(parsed))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give memory that was freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function over batches that gives the memory it freed back at the end: Python workers live on for later tasks, and would keep it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def utf8(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str], count: str, by: list[str], hot: int = 1000, most: int = 10_000) -> DataFrame:
    """``rows`` left-joined to ``named``, a written table of unique ``keys`` whose column ``count`` says how many rows hold each.

    Rows of a common key would all end in one task. The commonest keys, ``most`` of them at the
    most and each of over ``hot`` rows, are broadcast instead, and their rows and those of null
    keys are dealt by a hash of the columns ``by``. ``keys`` are bigint columns.
    """
    values = [c for c in named.columns if c not in keys]
    near, deal = fresh(rows, "near_", "deal_")
    top = named.filter(F.col(count) > hot).orderBy(F.desc(count)).limit(most)
    top = top.select(*keys, F.struct(*values).alias(near))
    found = rows.join(F.broadcast(top), keys, "left")
    hashed = F.xxhash64(*by)
    away = F.col(near).isNotNull() | F.col(keys[0]).isNull()
    far = named.select(F.col(keys[0]).alias(deal), *(F.col(k).alias(f"{deal}{i}") for i, k in enumerate(keys[1:])), F.struct(*values).alias(f"{deal}v"))
    on = F.when(away, hashed).otherwise(F.col(keys[0])) == F.col(deal)
    for i, k in enumerate(keys[1:]):
        on = on & (F.col(k) == F.col(f"{deal}{i}"))
    out = found.join(far, on, "left")
    value = F.when(F.col(near).isNotNull(), F.col(near)).when(F.col(keys[0]).isNotNull(), F.col(f"{deal}v"))
    return out.select(*rows.columns, *(value[v].alias(v) for v in values))
