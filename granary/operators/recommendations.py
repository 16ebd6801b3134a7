"""Recommendations of several parts brought under one dataset, and the test for parts of one dataset."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"([^/\\]+)_part_\d+\.(?:parquet|pq)$", re.I)


def rescope(recs: DataFrame, root: str) -> DataFrame:
    """Values of dataset scopes, own or parent, become ``root``."""
    value = F.when(F.col("scope.perimeter") == "dataset", F.lit(root)).otherwise(F.col("scope.value"))
    parent = F.col("scope.parent_scope")
    named = F.when(parent["perimeter"] == "dataset", parent.withField("value", F.lit(root))).otherwise(parent)
    return recs.withColumn("scope", F.col("scope").withField("value", value).withField("parent_scope", named))


def first_of_each(recs: DataFrame, order: str) -> DataFrame:
    """Of rows equal in content, type and scope value, the first by ``order``; in that order. Firsts are found before the shuffle."""
    first = F.min_by(F.struct(*recs.columns), F.col(order)).alias("first")
    return recs.groupBy("content", "type", F.col("scope.value").alias("of")).agg(first).select("first.*").orderBy(order)


def one_dataset(items: Iterable[str], names: Iterable[str] | None, dataset: str) -> bool:
    """Whether several items are parts of one dataset: names all automatic (``dataset``_number; none given counts too), or paths of one base name before its part number."""
    items, names = [str(i) for i in items], [str(n) for n in names or ()]
    if len(items) < 2:
        return False
    if all(re.fullmatch(re.escape(dataset) + r"_\d+", n) for n in names):
        return True
    found = [_PART.search(i) for i in items]
    return all(found) and len({m[1] for m in found}) == 1


def one_base(df: DataFrame, path: str) -> DataFrame:
    """One row (chunked): whether the distinct paths in a column are several parts of one base name."""
    base = F.regexp_extract(path, r"([^/\\]+)_part_\d+\.(parquet|pq)$", 1)
    one = (F.count_distinct(F.col(path)) > 1) & (F.count_distinct(base) == 1) & (F.min(base) != "")
    return df.agg(one.alias("chunked"))
