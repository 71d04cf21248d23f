"""Sinks: delimited text with preambles, JSON and JSON Lines, Parquet, schemas, learning sets.

Bodies are written by the engine; only preambles, schemas and metadata, whose size depends
on the number of columns, are written by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.errors import ExportError
from helixmill.operators.matrix import feature_quantiles, numeric_columns, to_long
from helixmill.operators.quality import top_values
from helixmill.session import durable


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file on any file system the engine knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def as_line(c: Column, kind: T.DataType) -> Column:
    """A value as text: NaN and NULL are missing, times are ISO."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def preamble(df: DataFrame, metadata: Mapping[str, object], run_at: str) -> list[str]:
    return [*[f"# {k}: {v}" for k, v in metadata.items()], f"# export date: {run_at}", f"# {df.count()} samples, {len(df.columns)} features", "# written by helixmill"]


def write_csv(df: DataFrame, path: str, sep: str = ",", metadata: Mapping[str, object] | None = None, run_at: str | None = None, files: int | None = None) -> str:
    """A folder of part files with a header each; with ``metadata`` the preamble stands in ``_preamble.txt``.

    With ``files=1`` a single file is written for small results, its preamble in the body.
    """
    lines = preamble(df, metadata, run_at or datetime.now().isoformat()) if metadata is not None else []
    flat = df.select(*[as_line(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    if files == 1 and lines:
        quote = lambda c: F.when(c.rlike(f'["\n\r]|{sep}'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        body = flat.select(F.concat_ws(sep, *[F.coalesce(quote(F.col(f"`{c}`")), F.lit("")) for c in flat.columns]).alias("value"))
        spark = df.sparkSession
        top = spark.createDataFrame([(line,) for line in [*lines, sep.join(df.columns)]], "value string").coalesce(1)
        # a union keeps its parts in order, so the preamble comes first in the single file
        top.union(body).coalesce(1).write.mode("overwrite").text(path)
        return path
    writer = (flat.coalesce(files) if files else flat).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"')
    writer.csv(path)
    if lines:
        write_text(df.sparkSession, f"{path}/_preamble.txt", "\n".join(lines) + "\n")
    return path


# Words in a column's name and what such a column holds.
DESCRIPTIONS = [
    (("id", "patient"), "Identifier of the patient or sample"),
    (("tp53", "brca", "egfr", "kras", "pten", "gene", "expression"), "Gene expression value"),
    (("age",), "Age in years"), (("sex", "gender"), "Sex of the patient"), (("stage",), "Tumor stage"), (("survival",), "Survival time"), (("treatment", "response"), "Response to treatment"),
]


def describe_column(name: str) -> str:
    return next((text for words, text in DESCRIPTIONS if any(w in name.lower() for w in words)), f"Measured value of {name}")


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column_name, description, data_type, example); the example is the smallest value that is not NULL."""
    one = df.agg(*[F.min(as_line(F.col(f"`{f.name}`"), f.dataType)).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(describe_column(f.name)).alias("description"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_{i}").alias("example")) for i, f in enumerate(df.schema.fields)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def write_csv_with_dictionary(df: DataFrame, path: str, sep: str = ",") -> str:
    write_csv(df, path, sep)
    lines = [f"# {r['column_name']}: {r['description']} ({r['data_type']}), for example {r['example']}" for r in data_dictionary(df).collect()]
    write_text(df.sparkSession, f"{path}/_dictionary.txt", "\n".join(lines) + "\n\n")
    return path


def write_csv_by(df: DataFrame, path: str, column: str, sep: str = ",") -> str:
    """A folder of files per value of ``column``."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').partitionBy(column).csv(path)
    return path


def bioconductor(df: DataFrame, feature: str) -> DataFrame:
    """Feature names first, then the number columns."""
    return df.select(feature, *numeric_columns(df, [feature]))


def export_problems(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> tuple[list[str], list[str]]:
    """Errors (no rows, columns without a value) and warnings (values outside their range)."""
    cols = df.columns
    bad = [F.count_if((F.col(f"`{c}`") < a) | (F.col(f"`{c}`") > b)).alias(f"r_{i}") for i, (c, (a, b)) in enumerate((ranges or {}).items())]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c_{i}") for i, c in enumerate(cols)], *bad).first()
    errors = ["the table is empty"] if not row["n"] else [f"{c} has no value" for i, c in enumerate(cols) if not row[f"c_{i}"]]
    return errors, [f"{c}: {row[f'r_{i}']} values outside their range" for i, c in enumerate(ranges or {}) if row[f"r_{i}"]]


def write_csv_validated(df: DataFrame, path: str, ranges: Mapping[str, tuple[float, float]] | None = None, **options) -> list[str]:
    """Write only a table without errors; returns the warnings."""
    errors, warnings = export_problems(df, ranges)
    if errors:
        raise ExportError("; ".join(errors))
    write_csv(df, path, **options)
    return warnings


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object that keeps its NULLs."""
    clean = [F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> str:
    json_lines(df).write.mode("overwrite").text(path)
    return path


def write_json(df: DataFrame, path: str, metadata: Mapping[str, object] | None = None, schema: bool = False, run_at: str | None = None) -> str:
    """JSON Lines in ``path`` with metadata (and statistics) beside them in ``_metadata.json``."""
    write_json_lines(df, path)
    about = {"metadata": {"export_date": run_at or datetime.now().isoformat(), "n_samples": df.count(), "n_features": len(df.columns), **(metadata or {})}}
    if schema:
        about["schema"] = {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "column_name"} for r in column_statistics(df).collect()}
    write_text(df.sparkSession, f"{path}/_metadata.json", json.dumps(about, indent=1, default=str))
    return path


def json_document(df: DataFrame, metadata: Mapping[str, object] | None = None, run_at: str = "", most: int = 100_000) -> str:
    """One JSON document {metadata, data} for results of at most ``most`` rows."""
    rows = [r[0] for r in json_lines(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ExportError(f"more than {most} rows: write JSON Lines instead")
    about = {"export_date": run_at, "n_samples": len(rows), "n_features": len(df.columns), **(metadata or {})}
    return f'{{"metadata": {json.dumps(about)}, "data": [{", ".join(rows)}]}}'


def valid_envelope(document: str) -> list[str]:
    """What a document lacks to be an export: its parts and their kinds."""
    try:
        d = json.loads(document)
    except ValueError as error:
        return [f"not JSON: {error}"]
    wrong = [] if isinstance(d, dict) else ["not an object"]
    for part, kind in (("metadata", dict), ("data", list)):
        if not wrong and not isinstance(d.get(part), kind):
            wrong.append(f"{part} is missing or of the wrong kind")
    return wrong


def api_envelope(df: DataFrame, run_at: str = "", version: str = "1.0", most: int = 100_000) -> str:
    inner = json.loads(json_document(df, run_at=run_at, most=most))
    return json.dumps({"status": "success", "version": version, "timestamp": run_at, "count": len(inner["data"]), "data": inner["data"]})


def write_json_by_sample(df: DataFrame, path: str, key: str) -> str:
    """A folder per sample with its rows as JSON."""
    df.write.mode("overwrite").partitionBy(key).json(path, ignoreNullFields=False)
    return path


def column_statistics(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_missing, missing_percent, min, max, mean, median, std, n_unique, top): a statistical schema."""
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in numbers]
    long = to_long(df.select(*[F.col(f"`{c}`") for c in numbers]).withColumn("_k", F.lit(0)), "_k", numbers) if numbers else None
    v = F.col("value")
    parts = []
    kind = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    if numbers:
        s = long.groupBy("feature").agg(F.count_if(v.isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count_distinct(v).alias("n_unique"))
        s = s.join(feature_quantiles(long, {"median": 0.5}), "feature", "left")
        parts.append(s.select(F.col("feature").alias("column_name"), kind[F.col("feature")].alias("data_type"), "n_missing", (F.col("n_missing") * 100.0 / F.col("n")).alias("missing_percent"), "min", "max", "mean", "median", "std", "n_unique", F.lit(None).cast("string").alias("top")))
    if texts:
        pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("c"), as_line(F.col(f"`{f.name}`"), f.dataType).alias("v")) for f in df.schema.fields if f.name in texts])).alias("p")
        s = df.select(pairs).groupBy(F.col("p.c").alias("column_name")).agg(F.count_if(F.col("p.v").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"), F.count_distinct("p.v").alias("n_unique"))
        flat = df.select(*[as_line(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name in texts])
        top = top_values(flat, texts).groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda r: F.concat(r["value"], F.lit(":"), r["n"].cast("string"))), ",").alias("top"))
        none = lambda n: F.lit(None).cast("double").alias(n)
        parts.append(s.join(top, "column_name", "left").select("column_name", kind[F.col("column_name")].alias("data_type"), "n_missing", (F.col("n_missing") * 100.0 / F.col("n")).alias("missing_percent"), none("min"), none("max"), none("mean"), none("median"), none("std"), "n_unique", "top"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def json_types(df: DataFrame) -> DataFrame:
    """(column_name, json_type, json_format, nullable, required): a column that is never NULL is required."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])

    def kind(t: T.DataType) -> tuple[str, str | None]:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer", None
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "number", None
        if isinstance(t, T.BooleanType):
            return "boolean", None
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return "string", "date-time"
        return ("array", None) if isinstance(t, T.ArrayType) else ("object", None) if isinstance(t, (T.MapType, T.StructType)) else ("string", None)

    rows = []
    for i, f in enumerate(df.schema.fields):
        name, fmt = kind(f.dataType)
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(name).alias("json_type"), F.lit(fmt).cast("string").alias("json_format"), (F.col(f"_{i}") > 0).alias("nullable"), (F.col(f"_{i}") == 0).alias("required")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def json_schema_text(df: DataFrame, title: str = "dataset") -> str:
    """A draft-07 JSON Schema of the table's rows."""
    fields, required = {}, []
    for r in json_types(df).collect():
        fields[r["column_name"]] = {"type": [r["json_type"], "null"] if r["nullable"] else r["json_type"], **({"format": r["json_format"]} if r["json_format"] else {})}
        required += [r["column_name"]] if r["required"] else []
    return json.dumps({"$schema": "http://json-schema.org/draft-07/schema#", "title": title, "type": "array", "items": {"type": "object", "properties": fields, "required": required}}, indent=1)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy", block_bytes: int | None = None) -> str:
    """Parquet, partitioned only if all partition columns exist; an empty table is an error."""
    if not df.limit(1).count():
        raise ExportError("the table is empty")
    writer = df.write.mode("overwrite").option("compression", compression)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if partition_by and all(c in df.columns for c in partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_parquet_bundle(tables: Mapping[str, DataFrame], path: str, **options) -> dict[str, str]:
    return {n: write_parquet(t, f"{path}/{n}.parquet", **options) for n, t in tables.items()}


def file_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) below a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    s = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target)
    return s.getFileCount(), s.getLength()


def parquet_summary(df: DataFrame, path: str, compressions: Sequence[str] = ("snappy", "gzip", "zstd")) -> list[dict[str, object]]:
    """Bytes on disk by compression."""
    out = []
    for c in compressions:
        write_parquet(df, f"{path}/{c}", compression=c)
        files, size = file_sizes(df.sparkSession, f"{path}/{c}")
        out.append({"compression": c, "files": files, "bytes": size})
    return out


def narrowing(df: DataFrame, floats: bool = False) -> DataFrame:
    """(column_name, from_type, to_type): the narrowest signed type that holds every value of a whole-number column."""
    whole = [f for f in df.schema.fields if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    real = [f for f in df.schema.fields if floats and isinstance(f.dataType, T.DoubleType)]
    if not whole and not real:
        return df.sparkSession.createDataFrame([], "column_name string, from_type string, to_type string")
    one = df.agg(F.lit(1).alias("_one"), *[x for i, f in enumerate(whole) for x in (F.min(F.col(f"`{f.name}`")).cast("long").alias(f"a{i}"), F.max(F.col(f"`{f.name}`")).cast("long").alias(f"b{i}"))])

    def fits(i: int, bits: int) -> Column:
        return (F.col(f"a{i}") >= -(1 << (bits - 1))) & (F.col(f"b{i}") <= (1 << (bits - 1)) - 1)

    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("from_type"), F.when(F.col(f"a{i}").isNull(), F.lit(f.dataType.simpleString())).when(fits(i, 8), "tinyint").when(fits(i, 16), "smallint").when(fits(i, 32), "int").otherwise("bigint").alias("to_type")) for i, f in enumerate(whole)]
    rows += [F.struct(F.lit(f.name).alias("column_name"), F.lit("double").alias("from_type"), F.lit("float").alias("to_type")) for f in real]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def narrow(df: DataFrame, floats: bool = False) -> DataFrame:
    plan = {r["column_name"]: r["to_type"] for r in narrowing(df, floats).collect() if r["to_type"] != r["from_type"]}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in plan.items()})


def write_learning_set(df: DataFrame, path: str, key: str, label: str, metadata: Mapping[str, object] | None = None) -> dict[str, object]:
    """Train and test rows as Parquet by ``split``, and their metadata."""
    kept = durable(df)
    kept.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    counts = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    about = {"label": label, "key": key, "features": [c for c in df.columns if c not in (key, label, "split")], "rows": counts, **(metadata or {})}
    write_text(df.sparkSession, f"{path}/metadata.json", json.dumps(about, indent=1, default=str))
    write_text(df.sparkSession, f"{path}/summary.txt", f"{counts.get('train', 0)} train and {counts.get('test', 0)} test rows, {len(about['features'])} features, label {label}\n")
    return about
