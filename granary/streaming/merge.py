"""Metrics over a stream: each micro-batch adds its partial counts to a table; reading merges them.

Completeness and ranges merge exactly. A batch that is run again after a failure replaces
its own partials, which are kept in a folder named by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.completeness import partial_counts


def collect_partials(stream: DataFrame, folder: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame] = partial_counts, once: bool = True) -> StreamingQuery:
    """Start a query that writes ``partial`` of each micro-batch below ``folder``."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged(spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return merge(spark.read.parquet(folder).drop("batch"))


def duplicate_counts(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Copies of each key in windows of ``delay``: keyed state is bounded by the watermark, so copies farther apart are not seen as such."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, delay), *keys).agg(F.count(F.lit(1)).alias("copies"))
