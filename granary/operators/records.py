"""The long form of results: metric, recommendation and schema rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = "struct<perimeter:string,value:string,parent_scope:struct<perimeter:string,value:string>>"


def dataset_scope(name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    parent = F.lit(None).cast("struct<perimeter:string,value:string>")
    return F.struct(F.lit("dataset").alias("perimeter"), name.alias("value"), parent.alias("parent_scope")).cast(SCOPE)


def column_scope(column: Column, dataset: str) -> Column:
    parent = F.struct(F.lit("dataset").alias("perimeter"), F.lit(dataset).alias("value"))
    return F.struct(F.lit("column").alias("perimeter"), column.alias("value"), parent.alias("parent_scope")).cast(SCOPE)


def entry(key: str, value: Column, kind: str) -> Column:
    """A metric without its scope; ``kind``: text, int or float, the type that the JSON sink restores."""
    number = value.try_cast("double") if kind != "text" else value.cast("string").try_cast("double")
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), number.alias("value_num"), F.lit(kind).alias("value_type"))


def unfold(df: DataFrame, entries: list[Column], scope: Column) -> DataFrame:
    """A metric row for each entry of each row."""
    return df.select(scope.alias("scope"), F.inline(F.array(*entries))).select("key", "value", "value_num", "value_type", "scope")


def advice(df: DataFrame, content: Column, kind: str, scope: Column, level: Column) -> DataFrame:
    return df.select(content.alias("content"), F.lit(kind).alias("type"), level.alias("level"), scope.alias("scope"))
