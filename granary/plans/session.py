"""A quality check's session: configuration files, loading by trigger, and result lists."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from granary.plans.sinks import save_json, write_parts
from granary.plans.types import normalise
from granary.sources.registry import load


def read_config(path: str) -> dict:
    """A JSON file; {} where there is none. Malformed JSON raises."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Check:
    """Source and target of a check, and its results. Configurations may be given as dicts or paths; a source without a type raises."""

    def __init__(self, spark: SparkSession, config: dict | str = "pack_conf.json", source: dict | str = "source_conf.json", target: dict | str = "target_conf.json"):
        self.spark = spark
        self.config, self.source, self.target = (c if isinstance(c, dict) else read_config(c) for c in (config, source, target))
        if not self.source.get("type"):
            raise ValueError("the source has no type")
        self.results: dict[str, list[DataFrame]] = {"metrics": [], "recommendations": [], "schemas": []}

    def job(self) -> dict:
        """Options of a load: those of job.source, the job's, and the top level's, in falling priority."""
        job = self.config.get("job") or {}
        return {k: v for k, v in self.config.items() if k != "job"} | {k: v for k, v in job.items() if k != "source"} | (job.get("source") or {})

    def load(self, trigger: str = "source", what=None) -> dict[str, DataFrame]:
        """DataFrames of the source or target by name, lazily."""
        if trigger not in ("source", "target"):
            raise ValueError("load source or target")
        job = self.job()
        return load(self.spark, getattr(self, trigger), what if what is not None else job.get("table_or_query"), job)

    def materialise(self, trigger: str = "source", what=None, ordered: bool = True) -> list[str]:
        """Load, bring types to those of Parquet (``normalise``) and write bounded parts under stable names; their paths."""
        job, conf = self.job(), getattr(self, trigger)
        out = []
        for name, df in self.load(trigger, what).items():
            item = os.path.splitext(os.path.basename(conf["config"].get("path", name)))[0] if name == "file" else name
            out += write_parts(normalise(df), job.get("parquet_output_dir", "./parquet"), "file" if name == "file" else conf["type"], item, int(job.get("chunk_rows", 100_000)), ordered)
        return out

    def add(self, kind: str, rows: DataFrame) -> None:
        self.results[kind].append(rows)

    def save(self, folder: str = ".") -> list[str]:
        """Each kind of result to its JSON file."""
        return [save_json(reduce(DataFrame.unionByName, frames), kind, folder) for kind, frames in self.results.items() if frames]
