"""From a source configuration to DataFrames, by its type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.sources.database import Database
from granary.sources.files import SUFFIXES, read_file, read_path
from granary.sources.stores import STORES, read_store

FILES = ("file", "csv", "excel", "json", "parquet")
DATABASES = ("postgresql", "mysql", "oracle", "mssql", "sqlite", "mariadb")


def load(spark: SparkSession, source: dict, what=None, job: dict | None = None) -> dict[str, DataFrame]:
    """DataFrames by name. ``what``: table, statement or tables, for databases. ``job``: skiprows, schema, json_lines. Unknown types raise ValueError."""
    kind, config, job = source.get("type"), source.get("config") or {}, job or {}
    skiprows, lines = int(job.get("skiprows") or 0), bool(job.get("json_lines"))
    if kind in FILES:
        given = kind if kind in ("json", "parquet") and not config["path"].lower().endswith(tuple(SUFFIXES)) else None
        if "://" in config["path"] or given:
            return {"file": read_file(spark, config["path"], given, skiprows, lines)}
        return {"file": read_path(spark, config["path"], skiprows=skiprows, json_lines=lines)}
    if kind == "folder":
        return {"folder": spark.read.format(config.get("format", "parquet")).load(config["path"])}
    if kind in DATABASES:
        return Database(spark, {"type": kind} | config).scan(what, config.get("schema") or job.get("schema"))
    if kind in STORES:
        return {kind: read_store(spark, kind, config, skiprows, lines)}
    raise ValueError(f"unsupported source type: {kind}")
