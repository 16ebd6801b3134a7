"""Scalar functions on columns, and on names where the driver needs them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import __version__


def version() -> str:
    return __version__


def slug(name: str) -> str:
    """Lower-case ASCII name: accents dropped, ends trimmed, other runs one underscore (at the ends too)."""
    plain = unicodedata.normalize("NFKD", name).lower().strip()
    return re.sub("[^a-z0-9]+", "_", "".join(c for c in plain if c.isascii()))


def slug_ascii(c: Column) -> Column:
    """``slug`` of ASCII text, in the JVM."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")


@F.pandas_udf(T.StringType())
def slug_text(s: pd.Series) -> pd.Series:
    """``slug`` of any text; Spark has no compatibility decomposition of its own."""
    return s.map(slug, na_action="ignore")


def slug_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with slugs for names, and the original name of each. Names that share a slug raise, as one would hide the other."""
    names = [slug(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns share a slug: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names), dict(zip(names, df.columns, strict=True))


def subject(c: Column) -> Column:
    """The text before the first white space that "has" or "is" follows; empty where there is none."""
    return F.regexp_extract(c, r"^(.*?)\s+(has|is)", 1)


def level_of_text(c: Column) -> Column:
    """Level by the first percentage in a text: up to 70 info, up to 90 warning, up to 100 high; else info."""
    p = F.regexp_extract(c, r"(\d+(\.\d+)?)%", 1).try_cast("double")
    return F.when((p > 70) & (p <= 90), "warning").when((p > 90) & (p <= 100), "high").otherwise("info")


def level_of_rate(c: Column) -> Column:
    """Level of a duplication rate: above 0.7 high, above 0.3 warning."""
    return F.when(c > 0.7, "high").when(c > 0.3, "warning").otherwise("info")


def level_of_outliers(c: Column) -> Column:
    """Level of an outlier rate: above 0.5 high, above 0.3 warning."""
    return F.when(c > 0.5, "high").when(c > 0.3, "warning").otherwise("info")


def round_text(c: Column, decimals: int = 2) -> Column:
    """Numbers rounded, without zeros at the end of a fraction; other text as it is."""
    number = c.cast("string").try_cast("double")
    text = F.format_string(f"%.{decimals}f", F.round(number, decimals))
    if decimals:
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.when(number.isNull() | F.isnan(number), c.cast("string")).otherwise(text)


def flatten_one(df: DataFrame) -> DataFrame:
    """Struct columns replaced by their fields, named outer_inner with inner in lower case; one level."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name.lower()}") for x in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def clamp01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def number_text(c: Column) -> Column:
    """A double as text, with at least one decimal."""
    return F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1")


def missing(c: Column, kind: T.DataType) -> Column:
    """Null, or NaN where the type has one."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()
