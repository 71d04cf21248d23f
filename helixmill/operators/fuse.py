"""Fusing modalities: joins of tables on a sample key, early, late and intermediate integration."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.errors import IntegrationError
from helixmill.operators import align
from helixmill.operators.matrix import numeric_columns, prefixed
from helixmill.operators.normalize import normalize_wide


def scale_columns(df: DataFrame, key: str, method: str = "standard") -> DataFrame:
    """Scale the number columns of a wide table by any method of ``normalize``; ``none`` leaves them as they are."""
    return df if method == "none" else normalize_wide(df, key, method)


def join_on(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Inner join of all tables on the key."""
    if not tables:
        raise IntegrationError("nothing to fuse")
    return reduce(lambda a, b: a.join(b, key), tables.values())


def merge(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """The first table as it is, the later ones with their name before each column.

    Tables without the key, without rows, or without a common id are left out.
    """
    out = None
    for name, t in tables.items():
        if key not in t.columns:
            continue
        if out is None:
            out = t if t.limit(1).count() else None
            continue
        if t.join(out.select(key), key, "left_semi").limit(1).count():
            out = out.join(prefixed(t, name, key), key)
    if out is None:
        raise IntegrationError(f"no table has rows and {key}")
    return out


def with_clinical(df: DataFrame, clinical: DataFrame, key: str, scale: bool = True) -> DataFrame:
    """Left join of clinical columns, named ``clinical_...``; its numbers are scaled."""
    return df.join(prefixed(scale_columns(clinical, key) if scale else clinical, "clinical", key), key, "left")


def early(tables: Mapping[str, DataFrame], key: str, scaling: str = "standard", clinical: DataFrame | None = None) -> DataFrame:
    """All features side by side: align, prefix, scale, join."""
    aligned = align.align(tables, key)
    ready = {n: prefixed(scale_columns(t.select(key, *numeric_columns(t, [key])), key, scaling), n, key) for n, t in aligned.items()}
    out = join_on(ready, key)
    return out if clinical is None else with_clinical(out, clinical, key)


def late(tables: Mapping[str, DataFrame], key: str, scaling: str = "standard") -> dict[str, DataFrame]:
    """Aligned, scaled tables that stay apart, and ``integrated`` with the common keys."""
    aligned = align.align(tables, key)
    out = {n: scale_columns(t, key, scaling) for n, t in aligned.items()}
    out["integrated"] = next(iter(aligned.values())).select(key).distinct()
    return out


def intermediate(tables: Mapping[str, DataFrame], key: str, scaling: str = "standard", components: int = 50) -> DataFrame:
    """Wide modalities become principal components before they are joined."""
    from helixmill.operators.reduce import pca

    ready = {}
    for name, t in align.align(tables, key).items():
        columns = numeric_columns(t, [key])
        scaled = scale_columns(t.select(key, *columns), key, scaling)
        if len(columns) > components:
            scores = pca(scaled, key, columns, components).scores
            ready[name] = scores.withColumnsRenamed({f"PC{i + 1}": f"{name}_PC{i + 1}" for i in range(components)})
        else:
            ready[name] = prefixed(scaled, name, key)
    return join_on(ready, key)


def integrate(tables: Mapping[str, DataFrame], key: str, methods: tuple[str, ...] = ("early",), **options) -> dict[str, object]:
    """Results by method; a method that fails leaves its error instead."""
    known = {"early": early, "late": late, "intermediate": intermediate}
    out: dict[str, object] = {}
    for m in methods:
        if m not in known:
            raise IntegrationError(f"unknown method {m}")
        try:
            out[m] = known[m](tables, key, **options)
        except Exception as error:  # a method may fail alone
            out[m] = {"status": "failed", "error": str(error)}
    return out


def metrics(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(modality, n_samples, n_features, density, samples_per_feature); a missing cell counts as not 0."""
    parts = []
    for n, t in tables.items():
        columns = numeric_columns(t, [key])
        full = reduce(lambda a, b: a + b, [(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") != 0)).cast("int") for c in columns], F.lit(0))
        parts.append(t.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(full).alias("full")).select(
            F.lit(n).alias("modality"), "n_samples", F.lit(len(columns)).cast("long").alias("n_features"), F.try_divide(F.col("full"), F.col("n_samples") * F.lit(len(columns))).alias("density"), F.try_divide(F.col("n_samples"), F.lit(float(len(columns)))).alias("samples_per_feature")))
    return reduce(DataFrame.unionByName, parts)


def relative_metrics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each metric divided by its largest value over all rows."""
    top = rows.agg(*[F.max(c).alias(f"_m{i}") for i, c in enumerate(columns)]).withColumn("_one", F.lit(1))
    joined = rows.withColumn("_one", F.lit(1)).join(top, "_one")
    return joined.select(*[F.try_divide(F.col(c).cast("double"), F.col(f"_m{columns.index(c)}").cast("double")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def feature_vectors(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, feature, value): per common sample the ``{modality}_{column}`` values of its first row."""
    parts = []
    for n, t in align.align(tables, key).items():
        columns = numeric_columns(t, [key])
        one = t.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("x"))
        named = F.explode(F.array(*[F.struct(F.lit(f"{n}_{c}").alias("feature"), F.col(f"x.`{c}`").cast("double").alias("value")) for c in columns])).alias("f")
        parts.append(one.select(key, named).select(key, "f.*"))
    return reduce(DataFrame.unionByName, parts)
