"""Validation of tables against schemas with ranges, allowed values and nullability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.errors import ValidationError


@dataclass(frozen=True)
class Field:
    """What a column must be: its kind (string, double or long), and what its values must satisfy."""

    kind: str
    nullable: bool = True
    low: float | None = None
    low_open: bool = False
    allowed: tuple[str, ...] | None = None


# The schemas of the four kinds of tables.
SCHEMAS: dict[str, dict[str, Field]] = {
    "gene_expression": {
        "sample_id": Field("string", False), "gene_id": Field("string", False), "expression_value": Field("double", False, 0), "tpm": Field("double", True, 0), "fpkm": Field("double", True, 0),
        "gene_symbol": Field("string"), "chromosome": Field("string"), "start_position": Field("long"), "end_position": Field("long"), "strand": Field("string", True, allowed=("+", "-", ".")),
    },
    "clinical": {
        "patient_id": Field("string", False), "sample_id": Field("string", False), "age": Field("double", True, 0), "gender": Field("string", True, allowed=("male", "female", "M", "F", "other")),
        "tumor_stage": Field("string"), "tumor_grade": Field("string"), "survival_time": Field("double", True, 0), "vital_status": Field("string", True, allowed=("alive", "dead", "deceased")),
        "tumor_size": Field("double", True, 0), "lymph_nodes": Field("long", True, 0),
    },
    "proteomics": {
        "sample_id": Field("string", False), "protein_id": Field("string", False), "intensity": Field("double", False, 0), "protein_name": Field("string"), "gene_symbol": Field("string"),
        "normalized_intensity": Field("double"), "peptide_count": Field("long", True, 1),
    },
    "metabolomics": {
        "sample_id": Field("string", False), "metabolite_id": Field("string", False), "concentration": Field("double", False, 0), "metabolite_name": Field("string"),
        "normalized_concentration": Field("double"), "mz": Field("double", True, 0, True), "retention_time": Field("double", True, 0, True),
    },
}
# Which schema a table's name or columns suggest.
BY_NAME = {"gene_expression": "gene_expression", "transcriptomics": "gene_expression", "clinical": "clinical", "patient": "clinical", "proteomics": "proteomics", "protein": "proteomics", "metabolomics": "metabolomics", "metabolite": "metabolomics"}
BY_COLUMN = [("gene_expression", ("gene_id", "ensembl_id")), ("clinical", ("patient_id", "age", "gender")), ("proteomics", ("protein_id", "intensity")), ("metabolomics", ("metabolite_id", "concentration"))]

_KINDS = {"string": T.StringType, "double": (T.DoubleType, T.FloatType, T.DecimalType), "long": (T.LongType, T.IntegerType, T.ShortType, T.ByteType)}


def detect_schema(name: str, columns: Sequence[str]) -> str | None:
    for word, schema in BY_NAME.items():
        if word in name.lower():
            return schema
    return next((s for s, cs in BY_COLUMN if any(c in columns for c in cs)), None)


def _violation(c: Column, field: Field) -> list[tuple[str, Column]]:
    out = []
    if not field.nullable:
        out.append(("null", c.isNull()))
    if field.low is not None:
        out.append(("range", (c <= field.low) if field.low_open else (c < field.low)))
    if field.allowed is not None:
        out.append(("allowed", c.isNotNull() & ~c.isin(*field.allowed)))
    return out


def violations(df: DataFrame, schema: Mapping[str, Field], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """(column_name, check, n_failed) of every check in one aggregation; ``checks`` are further predicates by name."""
    jobs = [(c, n, bad) for c, f in schema.items() if c in df.columns for n, bad in _violation(F.col(f"`{c}`"), f)]
    jobs += [(n, "custom", ~F.coalesce(p, F.lit(False))) for n, p in (checks or {}).items()]
    if not jobs:
        return df.sparkSession.createDataFrame([], "column_name string, check string, n_failed long")
    one = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad) in enumerate(jobs)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("check"), F.col(f"_{i}").alias("n_failed")) for i, (c, n, _) in enumerate(jobs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def range_report(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column_name, n_outside, actual_min, actual_max, valid)."""
    from helixmill.functions.text import clean_number

    parts = []
    for c, (low, high) in ranges.items():
        x = clean_number(F.col(f"`{c}`"))
        parts += [F.count_if((x < low) | (x > high)).alias(f"n_{c}"), F.min(x).alias(f"a_{c}"), F.max(x).alias(f"b_{c}")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_outside"), F.col(f"a_{c}").alias("actual_min"), F.col(f"b_{c}").alias("actual_max"), (F.col(f"n_{c}") == 0).alias("valid")) for c in ranges])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def format_report(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(column_name, n_invalid): values whose beginning does not match the pattern."""
    one = df.agg(*[F.count_if(~F.col(f"`{c}`").cast("string").rlike(f"^(?:{p})")).alias(f"_{i}") for i, (c, p) in enumerate(patterns.items())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_invalid")) for i, c in enumerate(patterns)])).alias("r")).select("r.*")


def kind_matches(data: T.DataType, field: Field) -> bool:
    return isinstance(data, _KINDS[field.kind]) or (field.kind == "double" and isinstance(data, _KINDS["long"]))


def score(df: DataFrame, schema: Mapping[str, Field]) -> DataFrame:
    """One row: column coverage, share of right types, missing percent and 0-100 completeness."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in schema if c in types]
    coverage = len(present) / len(schema) if schema else 0.0
    right = sum(kind_matches(types[c], schema[c]) for c in present) / len(present) if present else 0.0
    gaps = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns], F.lit(0))
    missing = F.coalesce(F.avg(gaps) / float(max(len(df.columns), 1)), F.lit(0.0))
    return df.agg(missing.alias("m")).select(
        F.lit(coverage * 100).alias("coverage_percent"), F.lit(right * 100).alias("type_percent"), (F.col("m") * 100).alias("missing_percent"),
        ((0.4 * coverage + 0.4 * right + 0.2 * (1 - F.col("m"))) * 100).alias("completeness_score"),
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, if it has the columns, a row, and a value in every required column."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValidationError(f"missing columns: {', '.join(lost)}")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    if not row["n"]:
        raise ValidationError("the table is empty")
    hollow = [c for i, c in enumerate(columns) if not row[f"_{i}"]]
    if hollow:
        raise ValidationError(f"columns without a value: {', '.join(hollow)}")
    return df


def validate_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, schema, coverage_percent, ..., n_failed) for every table whose schema is recognised."""
    parts = []
    for name, df in tables.items():
        schema = detect_schema(name, df.columns)
        if schema is None:
            continue
        failed = violations(df, SCHEMAS[schema]).agg(F.sum("n_failed").alias("n_failed")).withColumn("_one", F.lit(1))
        parts.append(score(df, SCHEMAS[schema]).withColumn("_one", F.lit(1)).join(failed, "_one").drop("_one").select(F.lit(name).alias("table_name"), F.lit(schema).alias("schema"), "*"))
    if not parts:
        raise ValidationError("no table has a known schema")
    return reduce(DataFrame.unionByName, parts)
