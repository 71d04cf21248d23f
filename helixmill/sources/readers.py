"""Readers: delimited text, count files, clinical documents, entity text, series and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.errors import SourceError


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    """A delimited file with a header; lines that begin with ``comment`` are a preamble. Name the schema where you can."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """(gene_id, count) of lines of two tab-separated fields with a number; lines that begin with _ are summaries."""
    parts = F.split(F.col(line), "\t")
    kept = lines.filter(~F.col(line).startswith("_") & (F.size(parts) == 2))
    rest = [c for c in lines.columns if c != line]
    return kept.select(*rest, parts[0].alias("gene_id"), parts[1].try_cast("double").alias("count")).filter("count IS NOT NULL")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, gene_id, count) of a folder of count files, gzipped or not; the file's name is the case."""
    lines = spark.read.text(path).select("value", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\..*$", "").alias("case_id"))
    return parse_counts(lines)


def counts_matrix(long: DataFrame, cases: Sequence[str]) -> DataFrame:
    """One row per gene, one column per case: the mean count, 0 where there is none."""
    return long.groupBy("gene_id").pivot("case_id", list(cases)).agg(F.avg("count")).fillna(0.0)


CLINICAL_DOCUMENT = (
    "case_id string, demographic struct<age_at_index: double, gender: string, race: string, ethnicity: string>,"
    "diagnoses array<struct<primary_diagnosis: string, ajcc_pathologic_stage: string, tumor_grade: string, vital_status: string, days_to_death: double, days_to_last_follow_up: double>>,"
    "exposures array<struct<tobacco_smoking_status: string, alcohol_history: string>>"
)


def flatten_clinical(documents: DataFrame) -> DataFrame:
    """One flat row per clinical document: demographics, the first diagnosis and the first exposure."""
    d, x = F.try_element_at("diagnoses", F.lit(1)), F.try_element_at("exposures", F.lit(1))
    keys = [c for c in documents.columns if c not in ("demographic", "diagnoses", "exposures")]
    return documents.select(
        *keys, F.col("demographic.age_at_index").alias("age"), "demographic.gender", "demographic.race", "demographic.ethnicity",
        d["primary_diagnosis"].alias("primary_diagnosis"), d["ajcc_pathologic_stage"].alias("tumor_stage"), d["tumor_grade"].alias("tumor_grade"), d["vital_status"].alias("vital_status"),
        d["days_to_death"].alias("days_to_death"), d["days_to_last_follow_up"].alias("days_to_last_follow_up"), x["tobacco_smoking_status"].alias("smoking_status"), x["alcohol_history"].alias("alcohol_history"),
    )


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    return flatten_clinical(spark.read.schema(CLINICAL_DOCUMENT).option("multiLine", True).json(path))


def parse_entities(lines: DataFrame, line: str = "value", order: str = "line_no", document: str = "document", block: str | None = None) -> DataFrame:
    """(document, entity_no, entity_type, entity_id, key, values, data) of entity text.

    ``^TYPE = id`` opens an entity, ``!key = value`` is an attribute of it (repeated keys
    make a list; before the first entity they are the header), ``#`` lines are notes, all
    else is data of the entity. Lines are numbered within a ``block`` of a document (the whole of it, if none is
    named), and blocks by how many entities the earlier ones open, so no task sees a long document.
    """
    v = F.col(line)
    opened = v.startswith("^")
    kept = lines.filter(~v.startswith("#") & (F.trim(v) != "")).withColumn("_block", F.col(block).cast("long") if block else F.lit(0).cast("long"))
    before = Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block
    starts = kept.groupBy(document, "_block").agg(F.count_if(opened).alias("_n")).select(document, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(document, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = kept.withColumn("_k", F.sum(opened.cast("int")).over(w)).join(starts, [document, "_block"]).withColumn("entity_no", (F.col("_k") + F.col("_start")).cast("long")).drop("_k", "_start")
    head = F.split(F.regexp_replace(v, "^.", ""), "=", 2)
    kinds = named.filter(opened).select(document, "entity_no", F.trim(head[0]).alias("entity_type"), F.trim(F.get(head, F.lit(1))).alias("entity_id"))
    attribute = v.startswith("!")
    flat = named.filter(~opened).join(kinds, [document, "entity_no"], "left").select(
        document, "entity_no", "entity_type", "entity_id", "_block", order,
        F.when(attribute, F.trim(head[0])).alias("key"), F.when(attribute, F.trim(F.coalesce(F.get(head, F.lit(1)), F.lit("")))).otherwise(v).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_block", order, "text")))
    return flat.groupBy(document, "entity_no", "entity_type", "entity_id", "key").agg(F.transform(ordered, lambda s: s["text"]).alias("values"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """``parse_entities`` of files of any length, which are read in splits: a split's place in its file is the block."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
    # the numbers of lines grow within a split, and what is read again after a failure gets the same ones
    return parse_entities(read, block="block")


def characteristics(attributes: Column) -> Column:
    """A map from the entries of ``characteristics_ch1...`` keys, each "key: value"; the last of equal keys wins."""
    lists = F.flatten(F.map_values(F.map_filter(attributes, lambda k, v: k.startswith("characteristics_ch1"))))
    parts = F.transform(F.filter(lists, lambda x: x.contains(":")), lambda x: F.split(x, ":", 2))
    keys, values = F.transform(parts, lambda p: F.trim(p[0])), F.transform(parts, lambda p: F.trim(p[1]))
    # the last position of each key
    last = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: F.array_position(F.reverse(keys), F.element_at(keys, i)) == F.size(keys) - i + 1)
    entries = F.when(F.size(keys) == 0, F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.transform(last, lambda i: F.struct(F.element_at(keys, i).alias("key"), F.element_at(values, i).alias("value"))))
    return F.map_from_entries(entries)


def sample_metadata(samples: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The first entry of each list-valued attribute, or an empty text."""
    return samples.select(key, *[F.coalesce(F.try_element_at(F.col(f), F.lit(1)), F.lit("")).alias(f) for f in fields])


def platforms(samples: DataFrame, column: str) -> DataFrame:
    """The distinct entries of a list-valued column."""
    return samples.select(F.explode(column).alias(column)).distinct()


def samples_from_tables(tables: DataFrame, sample: str = "sample", probe: str = "probe", value: str = "VALUE") -> DataFrame:
    """(sample, feature, value) of per-sample tables."""
    if value not in tables.columns:
        raise SourceError(f"the tables have no column {value}")
    return tables.select(F.col(sample).alias("sample"), F.col(probe).alias("feature"), F.col(value).try_cast("double").alias("value"))
