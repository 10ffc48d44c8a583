"""Missing values: one notion (NULL) instead of NaN, sentinels and NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = -99


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None))


def sentinel_to_null(c: Column, sentinel: float = SENTINEL) -> Column:
    """The coded 'not recorded' value, and NaN, become NULL."""
    return F.nullif(c, F.lit(sentinel))


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column; other columns pass through."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if floating else df
