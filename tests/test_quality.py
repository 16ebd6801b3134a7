"""Hand-computed cases of the quality operators' edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import scalars as s
from granary.operators import completeness as comp
from granary.operators import duplicates as dup
from granary.operators import outliers as outl
from granary.operators import recommendations as recs
from granary.operators import timeliness as tim

NAN = float("nan")


def values(metrics, **where):
    return {(r["key"], r["scope"]["value"]): r["value"] for r in metrics.collect()}


def test_nulls_and_nan_are_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (NAN, "y")], "a double, b string")
    counts = comp.merge_counts(comp.partial_counts(df))
    assert [(r["column"], r["ratio"]) for r in comp.column_completeness(counts).collect()] == [("a", 0.33), ("b", 0.67)]
    assert tuple(comp.dataset_completeness(counts).first()) == (3, 2, 3, 0.5, 0.5)


def test_empty_dataset(spark):
    counts = comp.merge_counts(comp.partial_counts(spark.createDataFrame([], "a int")))
    assert tuple(comp.dataset_completeness(counts).first()) == (1, 1, 1, 1.0, 0.0)


def test_parts_of_different_columns(spark):
    counts = comp.merge_counts(comp.partial_counts(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")), comp.partial_counts(spark.createDataFrame([(1,), (2,)], "a int")))
    assert [r["ratio"] for r in comp.column_completeness(counts).collect()] == [1.0, 1.0]
    assert tuple(comp.dataset_completeness(counts).first())[:3] == (4, 2, 0)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_any_number_of_parts(spark, parts):
    rows = [(i, None if i % 3 else "x") for i in range(20)]
    frames = [spark.createDataFrame(rows[k::parts], "a int, b string") for k in range(parts)]
    counts = comp.merge_counts(*map(comp.partial_counts, frames))
    assert values(comp.completeness_metrics(counts, "d"))["completeness_score", "b"] == "0.35"


def test_schema_rows(spark):
    assert [(r["key"], r["value"]) for r in comp.schema_rows(spark.createDataFrame([(1, 2)], "z int, a int"), "d").collect()] == [("column", "a"), ("column", "z"), ("dataset", "d")]


def test_duplicates_merge_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (NAN,), (2.0,)], "k double")
    counts = dup.key_counts(df, ["k"])
    assert tuple(dup.duplicate_score(counts).first()) == (5, 2, 0.4, 0.6)
    assert {r["k"] for r in dup.duplicate_keys(counts).collect()} == {1.0, None}
    assert tuple(dup.duplicate_score(dup.key_counts(df.limit(0), ["k"])).first()) == (0, 0, 0.0, 1.0)
    with pytest.raises(ValueError):
        dup.key_counts(df, [])


def test_outlier_merge_and_advice(spark):
    rows = spark.createDataFrame([("x", 0.9, 2, 100), ("x", 0.5, 1, 300), (None, 0.57, 4, 400)], "column string, normality double, outliers long, rows long")
    stats = outl.merge_stats(rows)
    got = values(outl.outlier_metrics(stats, "d"))
    assert got["normality_score", "x"] == "0.6" and got["outliers", "x"] == "3" and got["outliers", "d"] == "4" and got["total_outliers_count", "d"] == "3"
    told = outl.outlier_advice(stats, "d", 0.8).collect()
    assert [(r["scope"]["value"], r["level"]) for r in told] == [("x", "warning"), ("d", "warning"), ("d", "info")]
    assert "57.0%" in told[1]["content"]
    none = outl.outlier_advice(outl.merge_stats(rows.limit(0)), "d", 0.8).collect()
    assert [r["level"] for r in none] == ["high", "info"]


def test_detectors(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(200)] + [(1000.0,), (None,), (NAN,)], "v double")
    assert outl.zscore_outliers(df, "v").first()["outliers"] == 1
    assert outl.iqr_outliers(df, "v").first()[2:] == (1, 201)


def test_timeliness(spark):
    as_of = datetime(2026, 1, 1)
    r = spark.createDataFrame([("y", "year", "2001", "2010"), ("edge", "year", "2025", "2025"), ("t", "date", "2026-01-01 00:00:00", "2026-01-01 12:00:00"), ("none", "date", None, None)], "column string, kind string, lo string, hi string")
    aged = {x["column"]: (x["days_earliest"], x["days_latest"]) for x in tim.ages(r, as_of).collect()}
    assert aged == {"y": (9125, 5840), "edge": (365, 365), "t": (0, -1)}
    rows = tim.scored(tim.ages(r, as_of), tim.linear_decay(36_500))
    assert [x["scope"]["value"] for x in tim.timeliness_advice(rows, "d").collect()] == ["y"]
    got = values(tim.timeliness_metrics(rows, "d"))
    assert got["earliest_date", "t"] == "2026-01-01" and got["latest_year", "y"] == "2010" and ("score", "d") in got
    assert ("score", "d") not in values(tim.timeliness_metrics(rows, "d", ["other"]))


def test_recommendations(spark):
    scope = "struct<perimeter:string,value:string,parent_scope:struct<perimeter:string,value:string>>"
    rows = [(0, "c", "t", "high", ("dataset", "p1", None)), (1, "c", "t", "info", ("dataset", "p2", None)), (2, "c", "t", "info", ("column", "a", ("dataset", "p1")))]
    df = spark.createDataFrame(rows, f"n int, content string, type string, level string, scope {scope}")
    got = recs.first_of_each(recs.rescope(df, "root"), "n").collect()
    assert [(r["n"], r["level"], r["scope"]["value"]) for r in got] == [(0, "high", "root"), (2, "info", "a")]
    assert got[1]["scope"]["parent_scope"]["value"] == "root"


def test_parts_of_one_dataset():
    assert recs.one_dataset(["p/x_part_1.parquet", "q/x_part_2.parquet"], ["given", "names"], "d")
    assert not recs.one_dataset(["x_part_1.parquet", "y_part_1.parquet"], ["given", "names"], "d")
    assert recs.one_dataset([1, 2], ["d_1", "d_2"], "d") and recs.one_dataset([1, 2], None, "d") and not recs.one_dataset([1], None, "d")


def test_scalars(spark):
    assert s.slug("  Été (2024) ") == "ete_2024_"
    row = spark.createDataFrame([("70%", "70.5%", "90.5%", "101%", "none", "100", "1.50", "x", "the island")], "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    levels = row.select(*(s.level_of_text(F.col(c)).alias(c) for c in "abcde")).first()
    assert tuple(levels) == ("info", "warning", "high", "info", "info")
    assert tuple(row.select(s.round_text(F.col("f"), 0), s.round_text(F.col("g")), s.round_text(F.col("h"))).first()) == ("100", "1.5", "x")
    assert row.select(s.subject(F.col("i"))).first()[0] == "the"
    rate = spark.range(1).select(s.level_of_rate(F.lit(0.6)), s.level_of_outliers(F.lit(0.6))).first()
    assert tuple(rate) == ("warning", "high")
    with pytest.raises(ValueError):
        s.slug_columns(spark.createDataFrame([(1, 2)], ["a b", "a-b"]))
