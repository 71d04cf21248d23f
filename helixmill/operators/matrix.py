"""Sample-by-feature matrices: the long form (sample, feature, value), the wide form, and between.

The long form takes any number of features and rows; the wide form is for up to about a
thousand columns. Missing values are NULL in both: NaN becomes NULL on the way in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.text import clean_number
from helixmill.operators.value_counts import quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of a number type; name the keys in ``exclude``, or they count as features."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def to_long(wide: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, feature, value) with a row for every cell, also for missing ones."""
    columns = list(columns if columns is not None else numeric_columns(wide, [key]))
    if not columns:
        return wide.limit(0).select(F.col(f"`{key}`"), F.lit("").alias("feature"), F.lit(None).cast("double").alias("value"))
    numbers = wide.select(F.col(f"`{key}`"), *[clean_number(F.col(f"`{c}`")).alias(c) for c in columns])
    return numbers.unpivot([F.col(f"`{key}`")], [F.col(f"`{c}`") for c in columns], "feature", "value")


def to_wide(long: DataFrame, key: str, feature: str, value: str, features: Sequence, fill: float | None = None) -> DataFrame:
    """One row per key and one column per feature, holding the mean of competing values."""
    out = long.groupBy(key).pivot(feature, list(features)).agg(F.avg(value))
    return out if fill is None else out.fillna(fill)


def transpose(wide: DataFrame, key: str, features: Sequence[str], keys: Sequence) -> DataFrame:
    """Rows become columns: one row per feature, one column per value of ``key``."""
    return to_wide(to_long(wide, key, features), "feature", key, "value", keys)


def transpose_long(wide: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(feature, key, value): the transpose of any number of rows, with a row for every cell, also for missing ones."""
    return to_long(wide, key, features).select("feature", F.col(f"`{key}`"), "value")


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c != key})


def by_feature(long: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One aggregation with all moments of every feature."""
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"), F.min(v).alias("low"), F.max(v).alias("high"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def value_frequencies(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))


def feature_quantiles(long: DataFrame, probabilities: Mapping[str, float], keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Exact interpolated quantiles per feature, whatever the number of rows."""
    return quantiles(value_frequencies(long, list(keys)), list(keys), probabilities)


def nonzero(value: Column, instead: float = 1.0) -> Column:
    """A divisor that is never 0 or NULL."""
    return F.when(value.isNull() | (value == 0), F.lit(instead)).otherwise(value)
