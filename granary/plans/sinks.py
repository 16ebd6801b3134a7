"""Sinks: Parquet parts of bounded size under stable names, and JSON lists of results."""

from __future__ import annotations

import json
import math
import os
from datetime import date, datetime, time, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.scalars import slug
from granary.plans.scratch import written


def base_name(source: str, item: str) -> str:
    return f"{slug(source)}_{slug(item)}"


def part_path(folder: str, base: str, k: int) -> str:
    return f"{folder.rstrip('/')}/{base}_part_{k}.parquet"


#: Rows of a partition are numbered in this many bits of monotonically_increasing_id.
_BITS = 33


def write_parts(df: DataFrame, folder: str, source: str, item: str, rows: int = 100_000, ordered: bool = True) -> list[str]:
    """Write parts of at most ``rows`` rows named source_item_part_k, k from 1; older parts of that name go. Returns the paths.

    ``ordered``: parts are full but for the last and keep the input's order; rows are written once with their
    place, and many tasks then write a part each. Otherwise tasks write at once and each may leave a smaller
    part. Older parts stay until all new rows are staged.
    """
    spark = df.sparkSession
    base = base_name(source, item)
    jvm = spark._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_{base}_staged")
    fs = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if ordered:
        part, at = "granary_part", "granary_at"
        placed = written(df.withColumn(at, F.monotonically_increasing_id()), "placed")
        pid = F.shiftright(at, _BITS)
        counts = placed.groupBy(pid.alias("pid_")).agg(F.count("*").alias("n_"))
        before = counts.select("pid_", F.coalesce(F.sum("n_").over(Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
        nth = F.col("before_") + F.col(at).bitwiseAND((1 << _BITS) - 1)
        numbered_ = placed.join(F.broadcast(before), pid == F.col("pid_")).withColumn(part, (F.floor(nth / rows) + 1).cast("bigint")).drop("pid_", "before_")
        out = numbered_.repartition(part).sortWithinPartitions(part, at).drop(at)
        out.write.mode("overwrite").partitionBy(part).parquet(staged.toString())
        names = [(int(f.getPath().getName().split("=")[1]), x.getPath().toString()) for f in fs.listStatus(staged) if f.isDirectory() for x in fs.listStatus(f.getPath()) if x.getPath().getName().endswith(".parquet")]
        names = [n for _, n in sorted(names)]
        if not names:  # an empty table is one empty part
            df.limit(0).coalesce(1).write.mode("overwrite").parquet(staged.toString())
    else:
        df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(staged.toString())
        names = []
    names = names or sorted(f.getPath().toString() for f in fs.listStatus(staged) if f.getPath().getName().endswith(".parquet"))
    paths = [part_path(folder, base, k) for k in range(1, len(names) + 1)]
    old = {f.getPath().getName(): f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(part_path(folder, base, 0).replace("_part_0.", "_part_*."))) or ()}
    for a, b in zip(names, paths, strict=True):
        target = jvm.org.apache.hadoop.fs.Path(b)
        if old.pop(target.getName(), None):
            fs.delete(target, False)
        fs.rename(jvm.org.apache.hadoop.fs.Path(a), target)
    for path in old.values():
        fs.delete(path, False)
    fs.delete(staged, True)
    return paths


def numbered(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` with part: the part, from 1, that each row would be in by ``order``.

    Rows are written once with the number of their range; ranks come from counts of ranges, so that no task
    sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("pid_", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("pid_").count()
    before = counts.select("pid_", F.coalesce(F.sum("count").over(Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    nth = F.row_number().over(Window.partitionBy("pid_").orderBy(*order)) - 1 + F.col("before_")
    return ranged.join(F.broadcast(before), "pid_").withColumn("part", (F.floor(nth / rows) + 1).cast("bigint")).drop("pid_", "before_")


def plain(value):
    """A value as JSON has it: numbers that aren't finite and times that aren't null; times as ISO text; keys as text."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, Decimal):
        value = int(value) if value.is_finite() and value == value.to_integral_value() and value.as_tuple().exponent >= 0 else float(value)
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value != value:  # not a time, not available
        return None
    if isinstance(value, (datetime, date, time)):
        return value.isoformat()
    if isinstance(value, timedelta):
        return str(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return str(value)


def record(row: Row) -> dict:
    """A result row as it is exported: metric values in their own type, empty parents left out."""
    out = row.asDict(recursive=True)
    if "value_type" in out:
        kind, number = out.pop("value_type"), out.pop("value_num")
        if kind == "int" and number is not None:
            out["value"] = int(number)
        elif kind == "float":
            out["value"] = number
    scope = out.get("scope")
    if scope and scope.get("parent_scope") is None:
        scope.pop("parent_scope", None)
    return plain(out)


def save_json(df: DataFrame, name: str, folder: str = ".") -> str:
    """Write result rows, which are few, as an indented list to name.json."""
    path = os.path.join(folder, f"{name}.json")
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([record(r) for r in df.collect()], f, indent=4, ensure_ascii=False)
    return path


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)
