"""Queries over sources and sinks: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.plans import adapters as a
from helixmill.session import shared_dir, table
from helixmill.sources import exports, fhir, readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R = "round({0}, 6) + 0.0"


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"


# --- sources -----------------------------------------------------------------------------
@query("SELECT l_suppkey AS case_id, 'G' || l_partkey AS gene_id, l_quantity AS count FROM lineitem WHERE l_linenumber NOT IN (1, 2)")
def htseq_parse(spark: SparkSession, root: str) -> DataFrame:
    i = table(spark, root, "lineitem")
    n = F.col("l_linenumber")
    line = F.when(n == 1, "__no_feature\t12").when(n == 2, F.concat(F.lit("G\tnot a number"))).otherwise(F.concat(F.lit("G"), F.col("l_partkey").cast("string"), F.lit("\t"), F.col("l_quantity").cast("string")))
    return readers.parse_counts(i.select(F.col("l_suppkey").alias("case_id"), line.alias("value")))


@query("SELECT l_partkey AS gene_id, " + ", ".join(f"coalesce(avg(l_quantity) FILTER (l_linenumber = {i}), 0) AS c{i}" for i in a.LINES) + " FROM lineitem GROUP BY ALL")
def counts_matrix(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("case_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("count"))
    return readers.counts_matrix(rows, [f"c{i}" for i in a.LINES])


@query("""SELECT row_id::VARCHAR AS case_id, CASE WHEN isnan(age) THEN NULL ELSE age END AS age, gender, NULL::VARCHAR AS race, NULL::VARCHAR AS ethnicity, NULL::VARCHAR AS primary_diagnosis, tumor_stage, tumor_grade, vital_status, NULL::DOUBLE AS days_to_death,
    NULL::DOUBLE AS days_to_last_follow_up, NULL::VARCHAR AS smoking_status, CASE WHEN row_id % 2 = 0 THEN 'yes' END AS alcohol_history FROM clinical""")
def clinical_json_flatten(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "clinical")
    exposures = F.when(F.col("row_id") % 2 == 0, F.array(F.struct(F.lit("yes").alias("alcohol_history"))))
    text = F.to_json(F.struct(
        F.col("row_id").cast("string").alias("case_id"), F.struct(F.when(~F.isnan("age"), F.col("age")).alias("age_at_index"), "gender").alias("demographic"),
        F.array(F.struct(F.col("tumor_stage").alias("ajcc_pathologic_stage"), "tumor_grade", "vital_status")).alias("diagnoses"), exposures.alias("exposures")))
    return readers.flatten_clinical(c.select(F.from_json(text, readers.CLINICAL_DOCUMENT).alias("d")).select("d.*"))


@query("SELECT 'doc' || n_regionkey AS document, 'NATION' AS entity_type, n_name AS entity_id, 'key' AS key, n_nationkey || ',' || n_regionkey AS text FROM nation UNION ALL SELECT 'doc' || n_regionkey, 'NATION', n_name, NULL, 'row of ' || n_name FROM nation UNION ALL SELECT DISTINCT 'doc' || n_regionkey, NULL, NULL, 'head', 'of ' || n_regionkey FROM nation")
def soft_parse(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    doc, k = F.concat(F.lit("doc"), F.col("n_regionkey").cast("string")).alias("document"), F.col("n_nationkey")
    s = lambda c: F.col(c).cast("string")
    lines = F.array(F.struct((k * 10).alias("line_no"), F.concat(F.lit("^NATION = "), "n_name").alias("value")), F.struct((k * 10 + 1).alias("line_no"), F.concat(F.lit("!key = "), s("n_nationkey")).alias("value")),
                    F.struct((k * 10 + 2).alias("line_no"), F.concat(F.lit("!key = "), s("n_regionkey")).alias("value")), F.struct((k * 10 + 3).alias("line_no"), F.lit("# note").alias("value")), F.struct((k * 10 + 4).alias("line_no"), F.concat(F.lit("row of "), "n_name").alias("value")))
    body = n.select(doc, F.explode(lines).alias("x")).select("document", "x.*")
    head = n.select(doc, F.lit(-1).alias("line_no"), F.concat(F.lit("!head = of "), s("n_regionkey")).alias("value")).distinct()
    parsed = readers.parse_entities(body.unionByName(head))
    return parsed.select("document", "entity_type", "entity_id", "key", F.array_join("values", ",").alias("text"))


@query("SELECT c_custkey, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer")
def characteristics_map(spark: SparkSession, root: str) -> DataFrame:
    first = F.array(F.lit("segment: old"), F.concat(F.lit("segment:  "), "c_mktsegment"), F.lit("no colon"))
    attributes = F.create_map(F.lit("characteristics_ch1"), first, F.lit("characteristics_ch1.1"), F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))), F.lit("title"), F.array(F.lit("a: b")))
    return table(spark, root, "customer").select("c_custkey", F.explode(readers.characteristics(attributes)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, c_mktsegment AS organism FROM customer")
def sample_metadata(spark: SparkSession, root: str) -> DataFrame:
    title = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name", F.lit("second")))
    return readers.sample_metadata(table(spark, root, "customer").select("c_custkey", title.alias("title"), F.array("c_mktsegment").alias("organism")), "c_custkey", ["title", "organism"])


@query("SELECT DISTINCT unnest([r_name, 'GPL' || r_regionkey]) AS platform FROM region")
def explode_platforms(spark: SparkSession, root: str) -> DataFrame:
    lists = table(spark, root, "region").select(F.array("r_name", F.concat(F.lit("GPL"), F.col("r_regionkey").cast("string"))).alias("platform"))
    return readers.platforms(lists, "platform")


# --- sinks, read again -------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_preamble_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = exports.write_csv(table(spark, root, "nation"), _path(spark), sep="\t", metadata={"project": "nations"}, run_at="2024-01-01T00:00:00", files=1)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", sep="\t", comment="#")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_partitioned_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = exports.write_csv_by(table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _path(spark), "o_orderstatus")
    return readers.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return readers.read_parquet(spark, exports.write_parquet(table(spark, root, "part"), _path(spark), partition_by=["p_type"])).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("SELECT row_id, CASE WHEN isnan(age) THEN NULL ELSE age END AS age, gender FROM clinical")
def jsonl_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = exports.write_json_lines(table(spark, root, "clinical").select("row_id", "age", "gender"), _path(spark))
    return spark.read.schema("row_id bigint, age double, gender string").json(path)


@query("SELECT 'n_nationkey' AS column_name, 'Identifier of the patient or sample' AS description, 'int' AS data_type, '0' AS example WHERE false UNION ALL SELECT 'r_regionkey', 'Measured value of r_regionkey', 'int', min(r_regionkey)::VARCHAR FROM region UNION ALL SELECT 'r_name', 'Measured value of r_name', 'string', min(r_name) FROM region")
def data_dictionary(spark: SparkSession, root: str) -> DataFrame:
    return exports.data_dictionary(table(spark, root, "region"))


_TYPES = {"row_id": ("integer", None), "patient_id": ("string", None), "age": ("number", None), "lymph_nodes": ("integer", None), "loaded_at": ("string", "date-time")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS json_type, {repr(f) if f else 'NULL::VARCHAR'} AS json_format, count(*) FILTER ({c} IS NULL) > 0 AS nullable, count(*) FILTER ({c} IS NULL) = 0 AS required FROM clinical" for c, (t, f) in _TYPES.items()))
def json_schema_columns(spark: SparkSession, root: str) -> DataFrame:
    return exports.json_types(table(spark, root, "clinical").select(*_TYPES))


_FITS = "CASE WHEN min({0}) >= -128 AND max({0}) <= 127 THEN 'tinyint' WHEN min({0}) >= -32768 AND max({0}) <= 32767 THEN 'smallint' WHEN max({0}) <= 2147483647 THEN 'int' ELSE 'bigint' END"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS from_type, {_FITS.format(c)} AS to_type FROM lineitem" for c, t in (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"))))
def downcast_plan(spark: SparkSession, root: str) -> DataFrame:
    return exports.narrowing(table(spark, root, "lineitem"))


@query("SELECT p_name AS feature, p_size, p_retailprice FROM part")
def bioconductor_matrix(spark: SparkSession, root: str) -> DataFrame:
    return exports.bioconductor(table(spark, root, "part").select(F.col("p_name").alias("feature"), "p_size", "p_retailprice", "p_type"), "feature")


# --- health records ----------------------------------------------------------------------
def _patients(spark: SparkSession, root: str) -> DataFrame:
    age = F.when(F.col("age").between(0, 120), F.col("age"))
    size = F.when(~F.isnan("tumor_size"), F.col("tumor_size"))
    return table(spark, root, "clinical").select(F.col("row_id").alias("patient"), "gender", age.alias("age"), "tumor_stage", size.alias("tumor_size"), "lymph_nodes", (F.col("row_id") % 100).cast("double").alias("gene_expression_TP53"))


_GENDER = "CASE lower(trim(gender)) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'man' THEN 'male' WHEN 'f' THEN 'female' WHEN 'female' THEN 'female' WHEN 'woman' THEN 'female' ELSE 'unknown' END"
_AGE = "CASE WHEN NOT isnan(age) AND age BETWEEN 0 AND 120 THEN age END"
_SIZE = "CASE WHEN NOT isnan(tumor_size) THEN tumor_size END"


@query(f"SELECT row_id::VARCHAR AS patient_id, {_GENDER} AS gender, strftime(make_date((2024 - floor({_AGE}))::INT, 1, 1), '%Y-%m-%d') AS birth_date FROM clinical")
def fhir_patient(spark: SparkSession, root: str) -> DataFrame:
    return fhir.patients(_patients(spark, root), "patient", 2024)


def _observed(field: str, display: str, code: str, unit: str, value: str, text: str) -> str:
    return f"SELECT row_id::VARCHAR AS patient_id, '{field}' AS field, '{display}' AS display, '{code}' AS code, ({value})::DOUBLE AS value, '{unit}' AS unit, ({text})::VARCHAR AS text FROM clinical WHERE ({value}) IS NOT NULL OR ({text}) IS NOT NULL"


_OBSERVED = " UNION ALL ".join([
    _observed("gene_expression_TP53", "TP53 gene expression", "48002-0", "TPM", "row_id % 100", "NULL"), _observed("age", "Age", "30525-0", "years", _AGE, "NULL"), _observed("tumor_stage", "Cancer stage", "399707004", "", "NULL", "tumor_stage"),
    _observed("tumor_size", "Tumor size", "33717-4", "mm", _SIZE, "NULL"), _observed("lymph_nodes", "Lymph nodes involved", "33717-4", "count", "lymph_nodes", "NULL"),
])


@query(_OBSERVED)
def fhir_observations(spark: SparkSession, root: str) -> DataFrame:
    return fhir.observations(_patients(spark, root), "patient")


@query(f"SELECT 'Observation' AS resource_type, count(*) AS n FROM ({_OBSERVED}) UNION ALL SELECT unnest(['Patient', 'DiagnosticReport', 'Specimen']), count(*) FROM clinical")
def fhir_resource_counts(spark: SparkSession, root: str) -> DataFrame:
    return fhir.resource_counts(fhir.entries(_patients(spark, root), "patient", 2024, "2024-01-01T00:00:00"))


@query()
def fhir_entries(spark: SparkSession, root: str) -> DataFrame:
    return fhir.entries(_patients(spark, root), "patient", 2024, "2024-01-01T00:00:00")


@query(" UNION ALL ".join(f"SELECT '{t}' AS resource_type, '{f}' AS field, 0::BIGINT AS n_missing" for t, fs in fhir.REQUIRED.items() for f in fs))
def fhir_validation(spark: SparkSession, root: str) -> DataFrame:
    return fhir.validate(fhir.entries(_patients(spark, root), "patient", 2024, "2024-01-01T00:00:00"))


@query("SELECT vec_id AS sample, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS d{i:02d}" for i in range(a.DIMS)) + " FROM embeddings")
def ml_export(spark: SparkSession, root: str) -> DataFrame:
    features = [f"d{i:02d}" for i in range(a.DIMS)]
    rows = a.embedded_wide(spark, root).select("sample", "label", F.when(F.col("sample") % 5 == 0, "test").otherwise("train").alias("split"), *features)
    path = _path(spark)
    exports.write_learning_set(rows, path, "sample", "label")
    return a.tidy(spark.read.parquet(f"{path}/data").select("sample", "label", "split", *features), features)
