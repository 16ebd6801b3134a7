"""Timeliness: ages of the earliest and latest year or date of columns, against a given time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import clamp01, number_text
from granary.operators.records import advice, column_scope, dataset_scope, entry, unfold

DAY = 86_400_000_000


def linear_decay(horizon_days: float = 365.0) -> Callable[[Column], Column]:
    """Score 1 at age 0, 0 at the horizon and beyond."""
    return lambda age: clamp01(1 - age / F.lit(float(horizon_days)))


def year_range(df: DataFrame, column: str, year: Column | None = None) -> DataFrame:
    """(column, kind, lo, hi): earliest and latest year, as text; one row, of nulls where there is no value."""
    y = year if year is not None else F.year(F.col(f"`{column}`"))
    return df.agg(F.min(y).cast("string").alias("lo"), F.max(y).cast("string").alias("hi")).select(F.lit(column).alias("column"), F.lit("year").alias("kind"), "lo", "hi")


def date_range(df: DataFrame, column: str) -> DataFrame:
    """(column, kind, lo, hi): earliest and latest time, as text. Times without a zone and dates alike."""
    t = F.col(f"`{column}`").cast("timestamp_ntz")
    return df.agg(F.min(t).cast("string").alias("lo"), F.max(t).cast("string").alias("hi")).select(F.lit(column).alias("column"), F.lit("date").alias("kind"), "lo", "hi")


def ages(ranges: DataFrame, as_of: datetime) -> DataFrame:
    """Merged ranges with days_earliest and days_latest. Years count 365 days; times count whole days, rounded down."""
    merged = ranges.filter("lo IS NOT NULL AND hi IS NOT NULL").groupBy("column", "kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def micros(c: Column) -> Column:
        # Seconds and fraction apart from any session zone.
        t = c.try_cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), t)

    now = F.lit(as_of.isoformat(sep=" "))

    def age(c: str) -> Column:
        by_year = (F.lit(as_of.year) - F.col(c).try_cast("int")) * 365
        by_date = F.floor((micros(now) - micros(F.col(c))) / F.lit(DAY))
        return F.when(F.col("kind") == "year", by_year.cast("bigint")).otherwise(by_date.cast("bigint"))

    return merged.withColumns({"days_earliest": age("lo"), "days_latest": age("hi")})


def scored(aged: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    return aged.withColumn("score", score(F.col("days_latest")))


def timeliness_metrics(rows: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Metric rows of scored ages; the dataset's score is the mean of unrounded scores of ``columns`` (empty: all), left out where there is none."""
    out = []
    for kind, unit in (("year", "year"), ("date", "date")):
        shown = F.col if kind == "year" else lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd")
        entries = [
            entry(f"earliest_{unit}", shown("lo"), "text"),
            entry(f"latest_{unit}", shown("hi"), "text"),
            entry(f"days_since_earliest_{unit}", F.col("days_earliest").cast("string"), "text"),
            entry(f"days_since_latest_{unit}", F.col("days_latest").cast("string"), "text"),
            entry("timeliness_score", number_text(F.round("score", 2)), "text"),
        ]
        out.append(unfold(rows.filter(F.col("kind") == kind), entries, column_scope(F.col("column"), dataset)))
    some = rows.filter(F.col("column").isin(columns)) if columns else rows
    mean = some.agg(F.round(F.avg("score"), 2).alias("score")).filter("score IS NOT NULL")
    out.append(unfold(mean, [entry("score", number_text(F.col("score")), "text")], dataset_scope(dataset)))
    return reduce(DataFrame.unionByName, out)


def timeliness_advice(rows: DataFrame, dataset: str) -> DataFrame:
    """A recommendation for each column whose latest value is more than 365 days old."""
    text = F.concat(F.lit("Nothing in column '"), F.col("column"), F.lit("' is from the last 365 days."))
    return advice(rows.filter("days_latest > 365"), text, "Latest Date far in the past", column_scope(F.col("column"), dataset), F.lit("high"))
