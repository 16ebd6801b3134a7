"""Type normalisation before results are written, as a select list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.files import typed


def normalise(df: DataFrame, flat: bool = False) -> DataFrame:
    """Bytes become text (bad bytes replaced); text columns whose every value reads as a number become numbers.

    Other types stay. ``flat``: nested, date and decimal values too become text or double, as flat formats have them.
    """
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            out[f.name] = c.cast("string")
        elif flat and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = F.to_json(c)
        elif flat and isinstance(f.dataType, T.DecimalType):
            out[f.name] = c.cast("double")
        elif flat and isinstance(f.dataType, T.DateType):
            out[f.name] = c.cast("string")
    df = df.withColumns(out) if out else df
    booleans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = typed(df)
    # Only numbers are read out of text here; truth values stay as they were written.
    keep = [n for n in booleans if isinstance(numbers.schema[n].dataType, T.BooleanType)]
    return numbers.withColumns({n: F.initcap(F.col(f"`{n}`").cast("string")) for n in keep}) if keep else numbers
