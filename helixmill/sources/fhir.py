"""Health-record resources (FHIR R4) of a table of patients, as rows of entries and as a bundle."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.errors import FHIRError
from helixmill.functions.ids import birth_date, gender
from helixmill.operators.matrix import numeric_columns

LOINC = "http://loinc.org"
SNOMED = "http://snomed.info/sct"
# Clinical fields with display name, unit and code.
CLINICAL_FIELDS = {
    "age": ("Age", "years", "30525-0", LOINC),
    "tumor_stage": ("Cancer stage", "", "399707004", SNOMED),
    "survival_time": ("Survival time", "months", "80437-2", LOINC),
    "tumor_size": ("Tumor size", "mm", "33717-4", LOINC),
    "lymph_nodes": ("Lymph nodes involved", "count", "33717-4", LOINC),
}
EXPRESSION_CODE = "48002-0"
REPORT_CATEGORY = "GE"
SCHEMA = "row_key string, seq int, resource_type string, resource_id string, full_url string, resource string, method string, url string"


def expression_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if "expression" in c.lower() or "_expr" in c.lower()]


def gene_of(column: str) -> str:
    out = column
    for part in ("gene_expression_", "expression_", "_expression", "_expr"):
        out = out.replace(part, "")
    return out


def patients(df: DataFrame, key: str, year: int) -> DataFrame:
    """(patient_id, gender, birth_date): what a Patient resource says of each row."""
    g = gender(F.col("gender")) if "gender" in df.columns else gender(F.col("sex")) if "sex" in df.columns else F.lit("unknown")
    age = F.col("age").cast("double") if "age" in df.columns else F.lit(None).cast("double")
    return df.select(F.col(key).cast("string").alias("patient_id"), g.alias("gender"), F.date_format(birth_date(age, year), "yyyy-MM-dd").alias("birth_date"))


def observations(df: DataFrame, key: str, run_at: str = "") -> DataFrame:
    """(patient_id, field, display, code, value, unit, text) of every clinical and expression value that is there."""
    rows = []
    numbers = numeric_columns(df)
    none = F.lit(None)

    def row(field: str, display: str, code: str, unit: str, c: str) -> Column:
        number = F.col(f"`{c}`").cast("double") if c in numbers else none.cast("double")
        text = none.cast("string") if c in numbers else F.col(f"`{c}`").cast("string")
        return F.struct(F.lit(field).alias("field"), F.lit(display).alias("display"), F.lit(code).alias("code"), number.alias("value"), F.lit(unit).alias("unit"), text.alias("text"))

    for c in expression_columns(df):
        rows.append(row(c, f"{gene_of(c)} gene expression", EXPRESSION_CODE, "TPM", c))
    for c, (display, unit, code, _) in CLINICAL_FIELDS.items():
        if c in df.columns:
            rows.append(row(c, display, code, unit, c))
    if not rows:
        raise FHIRError("no column can be observed")
    return df.select(F.col(key).cast("string").alias("patient_id"), F.explode(F.array(*rows)).alias("o")).select("patient_id", "o.*").filter("value IS NOT NULL OR text IS NOT NULL")


def entries(df: DataFrame, key: str, year: int, run_at: str) -> DataFrame:
    """One row per bundle entry, in the order of its row: patient, observations, report, specimen."""
    numbers, expression = numeric_columns(df), expression_columns(df)
    pid = F.col(key).cast("string")
    subject = F.struct(F.concat(F.lit("Patient/patient-"), pid).alias("reference"))
    code = lambda c, d, s=LOINC: F.struct(F.array(F.struct(F.lit(s).alias("system"), F.lit(c).alias("code"), F.lit(d).alias("display"))).alias("coding"))
    made: list[tuple[str, Column, Column, Column]] = []

    g = gender(F.col("gender")) if "gender" in df.columns else gender(F.col("sex")) if "sex" in df.columns else F.lit("unknown")
    age = F.col("age").cast("double") if "age" in df.columns else F.lit(None).cast("double")
    patient = F.struct(F.lit("Patient").alias("resourceType"), F.concat(F.lit("patient-"), pid).alias("id"), F.array(F.struct(F.lit("urn:patient-id").alias("system"), pid.alias("value"))).alias("identifier"), g.alias("gender"), F.date_format(birth_date(age, year), "yyyy-MM-dd").alias("birthDate"))
    made.append(("Patient", F.concat(F.lit("patient-"), pid), F.to_json(patient), F.lit(True)))

    def observe(kind: str, name: str, c: str, display: str, unit: str, loinc: str, system: str) -> None:
        x, rid = F.col(f"`{c}`"), F.concat(F.lit(f"{kind}-{name}-"), pid)
        value = F.struct(x.cast("double").alias("value"), F.lit(unit).alias("unit")).alias("valueQuantity") if c in numbers else x.cast("string").alias("valueString")
        body = F.struct(F.lit("Observation").alias("resourceType"), rid.alias("id"), F.lit("final").alias("status"), code(loinc, display, system).alias("code"), subject.alias("subject"), F.lit(run_at).alias("effectiveDateTime"), value)
        made.append(("Observation", rid, F.to_json(body), x.isNotNull()))

    for c in expression:
        observe("expression", gene_of(c), c, f"{gene_of(c)} gene expression", "TPM", EXPRESSION_CODE, LOINC)
    for c, (display, unit, loinc, system) in CLINICAL_FIELDS.items():
        if c in df.columns:
            observe("clinical", c, c, display, unit, loinc, system)
    if any("gene" in c.lower() and "expression" in c.lower() for c in df.columns):
        rid = F.concat(F.lit("omics-report-"), pid)
        results = F.array(*[F.struct(F.concat(F.lit(f"Observation/expression-{gene_of(c)}-"), pid).alias("reference")) for c in expression])
        body = F.struct(F.lit("DiagnosticReport").alias("resourceType"), rid.alias("id"), F.lit("final").alias("status"), F.array(code(REPORT_CATEGORY, "Genetics")).alias("category"), code("51969-4", "Genetic analysis report").alias("code"), subject.alias("subject"), results.alias("result"))
        made.append(("DiagnosticReport", rid, F.to_json(body), F.lit(True)))
    rid = F.concat(F.lit("specimen-"), pid)
    body = F.struct(F.lit("Specimen").alias("resourceType"), rid.alias("id"), F.lit("available").alias("status"), subject.alias("subject"))
    made.append(("Specimen", rid, F.to_json(body), F.lit(True)))

    packed = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(t).alias("resource_type"), r.alias("resource_id"), j.alias("resource"), keep.alias("keep")) for i, (t, r, j, keep) in enumerate(made)])
    return df.filter(pid.isNotNull()).select(pid.alias("row_key"), F.explode(packed).alias("e")).filter("e.keep").select(
        "row_key", "e.seq", "e.resource_type", "e.resource_id", F.concat(F.lit("urn:uuid:"), F.col("e.resource_id")).alias("full_url"), "e.resource", F.lit("PUT").alias("method"), F.concat_ws("/", F.col("e.resource_type"), F.col("e.resource_id")).alias("url")
    )


def bundle(entry_rows: DataFrame, run_at: str, most: int = 100_000) -> str:
    """A transaction bundle of at most ``most`` entries as one document."""
    rows = entry_rows.orderBy("row_key", "seq").limit(most + 1).collect()
    if len(rows) > most:
        raise FHIRError(f"more than {most} entries: write the entries instead")
    made = [{"fullUrl": r["full_url"], "resource": json.loads(r["resource"]), "request": {"method": r["method"], "url": r["url"]}} for r in rows]
    return json.dumps({"resourceType": "Bundle", "type": "transaction", "timestamp": run_at, "total": len(made), "entry": made})


def resource_counts(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


# Parts every resource of a type has.
REQUIRED: dict[str, Sequence[str]] = {"Patient": ["id", "gender"], "Observation": ["id", "status", "code", "subject"], "DiagnosticReport": ["id", "status", "code", "subject"], "Specimen": ["id", "subject"]}


def validate(entry_rows: DataFrame) -> DataFrame:
    """(resource_type, field, n_missing) of required parts that resources lack."""
    checks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, fs in REQUIRED.items() for f in fs])
    each = entry_rows.select("resource_type", "resource", F.explode(F.filter(checks, lambda c: c["t"] == F.col("resource_type"))).alias("c"))
    keys = F.json_object_keys("resource")
    return each.groupBy("resource_type", F.col("c.f").alias("field")).agg(F.count_if(~F.array_contains(keys, F.col("c.f"))).alias("n_missing"))


def validate_bundle(document: str) -> list[str]:
    """What a bundle document lacks."""
    try:
        d = json.loads(document)
    except ValueError as error:
        return [f"not JSON: {error}"]
    wrong = [f"{k} is missing" for k in ("resourceType", "type", "entry") if k not in d]
    if d.get("resourceType") not in (None, "Bundle"):
        wrong.append("not a Bundle")
    for e in d.get("entry", []):
        r = e.get("resource", {})
        wrong += [f"{r.get('resourceType')} {r.get('id')}: {f} is missing" for f in REQUIRED.get(r.get("resourceType"), []) if f not in r]
    return wrong
