"""Completeness by column and dataset, from partial counts that merge.

A part's counts are one aggregate over its rows; the long form is made of that one row. Parts
may lack columns: a column counts only the rows of parts that have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import clamp01, missing, number_text
from granary.operators.records import column_scope, dataset_scope, entry, unfold

PARTIAL = "column string, place int, present bigint, rows bigint, cells bigint"


def partial_counts(df: DataFrame) -> DataFrame:
    """(column, place, present, rows, cells): a row for each column, and one of null column for the part."""
    fields = df.schema.fields
    if len({f.name for f in fields}) < len(fields):
        raise ValueError("column names repeat")
    counts = [F.count(F.when(~missing(F.col(f"`{f.name}`"), f.dataType), 1)).alias(f"p{i}") for i, f in enumerate(fields)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    n, none = F.col("n"), F.lit(0).cast("bigint")

    def cell(column, place, present, cells):
        return F.struct(column.cast("string").alias("column"), F.lit(place).cast("int").alias("place"), present.cast("bigint").alias("present"), n.alias("rows"), cells.cast("bigint").alias("cells"))

    total = reduce(lambda a, b: a + b, (F.col(f"p{i}") for i in range(len(fields))), none)
    cells = [cell(F.lit(f.name), i, F.col(f"p{i}"), none) for i, f in enumerate(fields)]
    cells.append(cell(F.lit(None), -1, total, n * max(1, len(fields))))
    return row.select(F.inline(F.array(*cells)))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """One row for each column and one for all; columns by the place where they first stood, then name."""
    rows = reduce(DataFrame.unionByName, parts)
    sums = [F.sum(c).alias(c) for c in ("present", "rows", "cells")]
    return rows.groupBy("column").agg(F.min("place").alias("place"), *sums)


def column_completeness(counts: DataFrame) -> DataFrame:
    """(column, present, rows, ratio): ratio to 2 places; 0 where there are no rows."""
    ratio = F.round(F.col("present") / F.greatest("rows", F.lit(1)), 2)
    return counts.filter("column IS NOT NULL").orderBy("place", "column").select("column", "present", "rows", ratio.alias("ratio"))


def dataset_completeness(counts: DataFrame) -> DataFrame:
    """One row: n, n_var, n_cells_missing, p_cells_missing (6 places), score (2 places). An empty dataset has one row, one missing cell and score 0."""
    whole = F.col("column").isNull()
    one = counts.agg(
        F.coalesce(F.sum(F.when(whole, F.col("rows"))), F.lit(0)).alias("n"),
        F.count("column").alias("n_var"),
        F.coalesce(F.sum(F.when(whole, F.col("present"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(whole, F.col("cells"))), F.lit(0)).alias("cells"),
    )
    cells = F.greatest("cells", F.lit(1))
    p = clamp01((cells - F.col("present")) / cells)
    return one.select(
        F.greatest("n", F.lit(1)).cast("bigint").alias("n"),
        F.greatest("n_var", F.lit(1)).cast("bigint").alias("n_var"),
        F.greatest(cells - F.col("present"), F.lit(0)).cast("bigint").alias("n_cells_missing"),
        F.round(p, 6).alias("p_cells_missing"),
        F.round(1 - p, 2).alias("score"),
    )


def completeness_metrics(counts: DataFrame, dataset: str) -> DataFrame:
    """Metric rows of columns and dataset."""
    columns = unfold(column_completeness(counts), [entry("completeness_score", number_text(F.col("ratio")), "text")], column_scope(F.col("column"), dataset))
    whole = [entry(k, F.col(k), "int") for k in ("n", "n_var", "n_cells_missing")] + [entry("p_cells_missing", F.col("p_cells_missing"), "float"), entry("score", number_text(F.col("score")), "text")]
    return columns.unionByName(unfold(dataset_completeness(counts), whole, dataset_scope(dataset)))


def schema_rows(df: DataFrame, dataset: str) -> DataFrame:
    """(key, value, scope): a row for each column, by name, and one for the dataset. No row of ``df`` is read."""
    one = df.sparkSession.range(1)
    names = F.array(*(F.lit(n) for n in sorted(df.columns))) if df.columns else F.array().cast("array<string>")
    columns = one.select(F.explode(names).alias("value")).select(F.lit("column").alias("key"), "value", column_scope(F.col("value"), dataset).alias("scope"))
    whole = one.select(F.lit("dataset").alias("key"), F.lit(dataset).alias("value"), dataset_scope(dataset).alias("scope"))
    return columns.unionByName(whole)
