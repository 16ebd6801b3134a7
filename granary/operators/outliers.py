"""Outlier statistics: detectors that make partial results, and their merge into metrics and advice.

A partial result is (column, normality, outliers, rows), with a null column for the dataset as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import level_of_outliers, number_text
from granary.operators.records import advice, column_scope, dataset_scope, entry, unfold


def merge_stats(partials: DataFrame) -> DataFrame:
    """(column, normality, outliers, rows): outliers and rows summed, normality weighted by rows (0 without rows)."""
    n = F.sum("rows")
    mean = F.when(n > 0, F.sum(F.col("normality") * F.col("rows")) / n).otherwise(F.lit(0.0))
    return partials.groupBy("column").agg(mean.alias("normality"), F.sum("outliers").alias("outliers"), n.alias("rows"))


def _whole(stats: DataFrame) -> DataFrame:
    whole = F.col("column").isNull()
    mine = [F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)).alias(c) for c in ("normality", "outliers", "rows")]
    return stats.agg(*mine, F.coalesce(F.sum(F.when(~whole, F.col("outliers"))), F.lit(0)).alias("total")).withColumn("normality", F.round("normality", 2))


def outlier_metrics(stats: DataFrame, dataset: str) -> DataFrame:
    """Metric rows of merged ``stats``."""
    columns = stats.filter("column IS NOT NULL").orderBy("column").withColumn("normality", F.round("normality", 2))
    columns = unfold(columns, [entry("normality_score", F.col("normality"), "float"), entry("outliers", F.col("outliers"), "int")], column_scope(F.col("column"), dataset))
    whole = [entry("outliers", F.col("outliers"), "int"), entry("normality_score_dataset", F.col("normality"), "float"), entry("score", number_text(F.col("normality")), "text"), entry("total_outliers_count", F.col("total"), "int")]
    return columns.unionByName(unfold(_whole(stats), whole, dataset_scope(dataset)))


def outlier_advice(stats: DataFrame, dataset: str, threshold: float) -> DataFrame:
    """Recommendations: columns and dataset whose normality is below ``threshold``, and the total always. Percentages have 2 places."""
    columns = stats.filter("column IS NOT NULL").withColumn("normality", F.round("normality", 2)).filter(F.col("normality") < threshold).orderBy("column")
    percent = number_text(F.round(F.col("normality") * 100, 2))
    text = F.concat(F.lit("Normality of column '"), F.col("column"), F.lit("' is "), percent, F.lit("%, below the threshold."))
    out = advice(columns, text, "Outliers", column_scope(F.col("column"), dataset), level_of_outliers(1 - F.col("normality")))
    whole = _whole(stats)
    text = F.concat(F.lit(f"Normality of dataset '{dataset}' is "), percent, F.lit("%, below the threshold."))
    out = out.unionByName(advice(whole.filter(F.col("normality") < threshold), text, "Outliers", dataset_scope(dataset), level_of_outliers(1 - F.col("normality"))))
    text = F.concat(F.lit(f"Outliers found in dataset '{dataset}': "), F.col("total").cast("string"), F.lit("."))
    rate = F.col("total") / F.greatest("rows", F.lit(1))
    return out.unionByName(advice(whole, text, "Outliers", dataset_scope(dataset), level_of_outliers(rate)))


def zscore_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """(column, normality, outliers, rows): values beyond ``limit`` sample deviations of the mean; normality is the share of the others.

    The two moments are one row, which is broadcast to the second pass. Null and NaN don't count.
    """
    values = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    moments = values.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    out = values.join(F.broadcast(moments)).agg(F.count(F.when(F.abs(F.col("x") - F.col("mean")) > limit * F.col("sd"), 1)).alias("outliers"), F.count(F.lit(1)).alias("rows"))
    return _share(out, column)


def iqr_fences(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: q1, q3, low, high."""
    q = df.filter(F.col(f"`{column}`").isNotNull()).agg(F.percentile(f"`{column}`", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.element_at("q", 1), F.element_at("q", 2)
    return q.select(q1.alias("q1"), q3.alias("q3"), (q1 - factor * (q3 - q1)).alias("low"), (q3 + factor * (q3 - q1)).alias("high"))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """As ``zscore_outliers``, of values outside the quartile fences."""
    values = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    out = values.join(F.broadcast(iqr_fences(values, "x", factor))).agg(F.count(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), 1)).alias("outliers"), F.count(F.lit(1)).alias("rows"))
    return _share(out, column)


def _share(out: DataFrame, column: str) -> DataFrame:
    normality = F.when(F.col("rows") > 0, 1 - F.col("outliers") / F.col("rows")).otherwise(F.lit(0.0))
    return out.select(F.lit(column).alias("column"), normality.alias("normality"), "outliers", "rows")
