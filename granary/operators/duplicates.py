"""Duplicate keys: null and NaN are one key value. The only shuffle is on the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import clamp01, number_text
from granary.operators.records import dataset_scope, entry, unfold


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., copies): how many rows hold each key. Works on the key columns alone."""
    if not keys:
        raise ValueError("no key columns")
    count = "copies"
    while count in keys:
        count = "_" + count
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    columns = [F.when(~F.isnan(F.col(f"`{k}`")), F.col(f"`{k}`")).alias(k) if k in real else F.col(f"`{k}`") for k in keys]
    return df.select(*columns).groupBy(*(f"`{k}`" for k in keys)).agg(F.count(F.lit(1)).alias(count))


def duplicate_keys(counts: DataFrame) -> DataFrame:
    """Keys of more than one row."""
    return counts.filter(F.col(counts.columns[-1]) > 1)


def duplicate_score(counts: DataFrame) -> DataFrame:
    """One row: rows, duplicates (rows beyond the first of each key), rate, score (2 places). No rows: rate 0, score 1."""
    c = F.col(counts.columns[-1])
    one = counts.agg(F.coalesce(F.sum(c), F.lit(0)).alias("rows"), F.coalesce(F.sum(c - 1), F.lit(0)).alias("duplicates"))
    rate = F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows")).otherwise(F.lit(0.0))
    return one.select("rows", "duplicates", rate.alias("rate"), F.round(clamp01(1 - rate), 2).alias("score"))


def duplicate_metrics(counts: DataFrame, dataset: str) -> DataFrame:
    one = duplicate_score(counts)
    return unfold(one, [entry("score", number_text(F.col("score")), "text"), entry("duplicates", F.col("duplicates"), "int")], dataset_scope(dataset))
