"""File readers by format, local or in any store that Spark reaches."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that stand for a missing value in a CSV file, in the order of their code points.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SUFFIXES = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet", ".xlsx": "excel", ".xls": "excel"}


def format_of(path: str, given: str | None = None) -> str:
    """A format given wins; else by suffix, in any case; else csv."""
    return given.lower() if given else SUFFIXES.get(os.path.splitext(path.lower())[1], "csv")


def read_csv(spark: SparkSession, path: str, skiprows: int = 0, infer: bool = True) -> DataFrame:
    """A CSV file with a header row after ``skiprows`` lines.

    Rows of more fields than the header are left out, shorter ones end in nulls, and the usual
    texts for missing values are null. Types are inferred once over the whole input. Fields in
    quotes may hold separators and, without ``skiprows``, line ends. A file without a line raises; one without
    data rows gives an empty table. Repeated header names get a numbered suffix.
    """
    reader = spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if skiprows:
        # Skipped lines may have any form, so they go before the parser sees them. They lie in the file's first block, whose lines keep their order.
        at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
        lines = spark.read.text(path).select(F.col("value").alias("line"), at.alias("at"))
        top = lines.filter("at IS NOT NULL").orderBy("at").limit(skiprows + 1).collect()
        if len(top) <= skiprows:
            raise ValueError(f"{path}: no header after {skiprows} lines")
        header = next(csv.reader([top[-1]["line"]]))
        body = lines.filter(F.col("at").isNull() | (F.col("at") > top[-1]["at"])).select("line").filter("line <> ''")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header) + 1)])
        rows = body.select(F.from_csv("line", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"'}).alias("r")).select("r.*")
    else:
        first = spark.read.text(path).limit(1).first()
        if first is None:
            raise ValueError(f"{path}: empty file")
        header = next(csv.reader([first["value"]]))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header) + 1)])
        rows = reader.schema(schema).option("mode", "PERMISSIVE").option("header", True).option("enforceSchema", True).csv(path)
    names = _distinct(header)
    extra = f"c{len(header)}"
    rows = rows.filter(F.col(extra).isNull()).drop(extra).toDF(*names)
    rows = rows.select(*(F.when(~F.col(f"`{n}`").isin(*NULL_TEXTS), F.col(f"`{n}`")).alias(n) for n in names))
    return typed(rows) if infer else rows


def _distinct(header: list[str]) -> list[str]:
    out: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def typed(df: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where every value reads as one; a column without values as double. One pass finds all."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    tests = []
    for i, n in enumerate(texts):
        c = F.trim(F.col(f"`{n}`"))
        bad = {
            "l": c.try_cast("bigint").isNull() | ~c.rlike("^[+-]?[0-9]+$"),
            "d": c.try_cast("double").isNull() | c.rlike("[dDfF]$"),
            "b": ~c.isin("True", "False", "TRUE", "FALSE", "true", "false"),
        }
        tests += [F.count(F.when(c.isNotNull() & b, 1)).alias(f"{k}{i}") for k, b in bad.items()] + [F.count(c).alias(f"n{i}")]
    row = df.agg(*tests).first()
    out = {}
    for i, n in enumerate(texts):
        c = F.trim(F.col(f"`{n}`"))
        if row[f"n{i}"] == 0 or row[f"l{i}"] and not row[f"d{i}"]:
            out[n] = c.try_cast("double")
        elif not row[f"l{i}"]:
            out[n] = c.try_cast("bigint")
        elif not row[f"b{i}"]:
            out[n] = c.try_cast("boolean")
    return df.withColumns(out) if out else df


def read_file(spark: SparkSession, path: str, fmt: str | None = None, skiprows: int = 0, json_lines: bool = False) -> DataFrame:
    """Any supported format, lazily; an unknown format raises."""
    fmt = format_of(path, fmt)
    if fmt == "csv":
        return read_csv(spark, path, skiprows)
    if fmt == "json":
        return spark.read.option("multiLine", not json_lines).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "excel":
        from granary.sources.xlsx import XlsxSource

        spark.dataSource.register(XlsxSource)
        return typed(spark.read.format("granary_xlsx").option("skiprows", skiprows).load(path))
    raise ValueError(f"unknown format: {fmt}")


def read_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """A local file, or a folder's first .csv, else first .xlsx file by name. No such file raises FileNotFoundError; another suffix raises ValueError."""
    if os.path.isdir(path):
        found = [sorted(x for x in os.listdir(path) if x.endswith(s)) for s in (".csv", ".xlsx")]
        names = found[0] or found[1]
        if not names:
            raise FileNotFoundError(f"{path}: no .csv or .xlsx file")
        path = os.path.join(path, names[0])
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.endswith(tuple(SUFFIXES)) or path.endswith(".xls"):
        raise ValueError(f"{path}: unsupported suffix")
    return read_file(spark, path, **options)
