"""Identifiers: patients, barcodes, generated ids, and their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of patient ids in the order in which they are tried.
PATIENT_PATTERNS = [
    "(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})",
    "([A-Z]{2,3}[0-9]{2,4})",
    "([A-Z]{2,3}-[0-9]{2,4})",
    "(P[0-9]{3,6})",
    "(Patient[0-9]{2,4})",
    "([0-9]{4,8})",
]
# Fixed value: a sample barcode with its optional parts.
BARCODE_PATTERN = "(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}(?:-[A-Z0-9]{2})?(?:-[A-Z0-9])?(?:-[A-Z0-9]{2})?(?:-[A-Z0-9]{4})?)"
# Names of sample-id and gene-id columns in the order of preference.
SAMPLE_COLUMNS = ["sample_id", "sample", "patient_id", "patient", "subject_id", "subject", "sample_name", "sample barcode", "aliquot_id", "aliquot", "tcga_id", "tcga_sample", "gdc_id", "case_id"]
GENE_COLUMNS = ["gene_id", "ensembl_id", "entrez_id", "gene_symbol", "symbol"]


def patient_id(value: Column) -> Column:
    """The patient a sample id names, in upper case; ids of no known form are only trimmed."""
    trimmed = F.trim(value)
    found = [F.upper(F.nullif(F.regexp_extract(trimmed, f"(?i){p}", 1), F.lit(""))) for p in PATIENT_PATTERNS]
    return F.coalesce(*found, F.nullif(trimmed, F.lit("")))


def barcode(value: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(F.trim(value), f"(?i){BARCODE_PATTERN}", 1), F.lit("")))


def standard_id(source: str, value: Column) -> Column:
    """SOURCE_cleaned_hash in upper case; ids over 50 characters are cut and end in a lower-case hash."""
    clean = F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")
    digest = F.substring(F.md5(value), 1, 8)
    whole = F.upper(F.concat(F.lit(source), F.lit("_"), clean, F.lit("_"), digest))
    return F.when(F.length(whole) > 50, F.concat(F.substring(whole, 1, 42), digest)).otherwise(whole)


def sample_column(df: DataFrame, names: Sequence[str] = SAMPLE_COLUMNS) -> str:
    """The sample-id column: a known name, in any letter case, else one that sounds like it, else the first."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n in df.columns:
            return n
    for n in names:
        if n in lower:
            return lower[n]
    for c in df.columns:
        if any(w in c.lower() for w in ("sample", "patient", "subject")):
            return c
    return df.columns[0]


def gene_column(df: DataFrame) -> str | None:
    return next((c for c in GENE_COLUMNS if c in df.columns), None)


def gender(value: Column) -> Column:
    """male, female or unknown."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("m", "male", "man"), "male").when(v.isin("f", "female", "woman"), "female").otherwise("unknown")


def birth_date(age: Column, year: int) -> Column:
    """1 January of the year in which somebody of that age was born, seen from ``year``."""
    return F.make_date(F.lit(year) - F.floor(age).cast("int"), F.lit(1), F.lit(1))
