"""Identifier mapping and annotation by lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.errors import PreprocessingError

KINDS = ["ensembl", "entrez", "symbol"]


def clean_ids(df: DataFrame, column: str) -> DataFrame:
    """The distinct ids of a column without NULL and blank."""
    return df.select(column).filter(F.col(column).isNotNull() & (F.trim(F.col(column)) != "")).distinct()


def _form(kind: str, c: Column) -> Column:
    return F.upper(F.trim(c)) if kind == "symbol" else F.trim(c)


def lookup(genes: DataFrame, source: str, target: str) -> DataFrame:
    """(from_id, to_id) for one of the directions between ensembl, entrez and symbol; one target per id."""
    for k in (source, target):
        if k not in KINDS:
            raise PreprocessingError(f"unknown kind of id {k}")
    a, b = _form(source, F.col(source)), F.col(target)
    known = genes.filter(a.isNotNull() & (a != ""))
    return known.groupBy(a.alias("from_id")).agg(F.min(b).alias("to_id")).filter("to_id IS NOT NULL AND to_id <> ''")


def map_ids(df: DataFrame, column: str, genes: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with ``{target}_id``; rows whose id is not known are dropped. The same kind is the identity."""
    if source == target:
        return df.withColumn(f"{target}_id", F.col(column)).filter(F.col(f"{target}_id").isNotNull() & (F.col(f"{target}_id") != ""))
    return df.join(lookup(genes, source, target), _form(source, F.col(column)) == F.col("from_id")).drop("from_id").withColumnRenamed("to_id", f"{target}_id")


def mapping_stats(df: DataFrame, column: str, genes: DataFrame, source: str, target: str) -> DataFrame:
    """One row: distinct ids, how many are mapped, and their share."""
    known = lookup(genes, source, target).withColumn("hit", F.lit(1))
    all_ids = clean_ids(df, column)
    n, hit = F.count(F.lit(1)), F.count("hit")
    return all_ids.join(known, _form(source, F.col(column)) == F.col("from_id"), "left").agg(n.alias("n_ids"), hit.alias("n_mapped"), F.try_divide(hit * 100.0, n).alias("mapped_percent"))


def consolidate(base: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``base`` with annotation columns; of several sources the later one that knows a value wins."""
    out, fields = base, sorted({c for cs in columns.values() for c in cs})
    for name, df in sources:
        out = out.join(df.select(key, *[F.col(c).alias(f"_{name}_{c}") for c in columns[name]]), key, "left")
    value = lambda c: F.coalesce(*[F.col(f"_{n}_{c}") for n, _ in reversed(sources) if c in columns[n]])
    return out.select(*base.columns, *[value(c).alias(c) for c in fields])
