"""The general data-quality queries over the project's tables."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import fill, orphans, value_counts, wide_table
from helixmill.operators.matrix import to_long
from helixmill.session import durable, shared_dir, table

#: Valid values of the profiled columns, ends included.
RANGES = {"age": (0.0, 120.0), "tumor_size": (0.0, 300.0), "BRCA1": (0.0, None)}


PROFILED = {"clinical": ["age", "tumor_size"], "demo_expression_data": ["BRCA1"]}
#: Patterns of text columns in the profile of every column.
PATTERNS = {"patient_id": "^TCGA-[0-9A-Z][0-9A-Z]-[0-9A-Z][0-9A-Z][0-9A-Z][0-9A-Z]$", "sample_id": "^TCGA-[0-9A-Z][0-9A-Z]-[0-9A-Z][0-9A-Z][0-9A-Z][0-9A-Z]-[0-9][0-9][A-Z]$"}


def column_store(spark: SparkSession, root: str) -> DataFrame:
    """The maintained value counts of the profiled columns of the tables in ``root``.

    The store of a folder of tables has its place in the shared folder; a later call only counts loads that are new or have changed.
    """
    sources = {t: (table(spark, root, t), columns) for t, columns in PROFILED.items()}
    return value_counts.maintain(spark, store_path(spark, root, "profiled"), sources)


def store_path(spark: SparkSession, root: str, name: str) -> str:
    return f"{shared_dir(spark)}/helixmill-stores/{name}-{hashlib.sha256(root.encode()).hexdigest()[:16]}"


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    compared = value_counts.compare_loads(value_counts.profile(column_store(spark, root), RANGES))
    return compared.filter("differs").select("table_name", "column_name", "load_id")


def p2_profile(spark: SparkSession, root: str) -> DataFrame:
    compared = value_counts.compare_loads(value_counts.profile(column_store(spark, root), RANGES))
    rounded = {"missing_share", "invalid_share", "top_share", "min_value", "max_value", "median", "iqr", "entropy_bits"}
    names = ["table_name", "column_name", "load_id", "n_rows", "missing_share", "invalid_share", "n_distinct", "min_value", "max_value", "top_share", "median", "iqr", "entropy_bits", "differs"]
    return compared.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in names])


def p2_columns(spark: SparkSession, root: str) -> DataFrame:
    """Every column of clinical and demo_expression_data per load: missing, distinct, range, violated patterns, entropy and shift."""
    sources = {t: (table(spark, root, t), [c for c in table(spark, root, t).columns if c != "load_id"]) for t in PROFILED}
    # read several times below
    store = durable(value_counts.maintain(spark, store_path(spark, root, "columns"), sources))
    made = value_counts.profile(store, RANGES, PATTERNS).alias("p").join(value_counts.shifts(store).alias("s"), ["table_name", "column_name", "load_id"], "left")
    rounded = ["missing_share", "invalid_share", "min_value", "max_value", "top_share", "median", "iqr", "entropy_bits", "shift"]
    names = ["table_name", "column_name", "load_id", "n_rows", "missing_share", "invalid_share", "n_distinct", "min_value", "max_value", "min_text", "max_text", "top_share", "median", "iqr", "entropy_bits", "shift"]
    return made.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in rounded else F.col(c) for c in names])


def p2_increments(spark: SparkSession, root: str) -> DataFrame:
    """The store grown load by load beside one made at once: (table_name, column_name, n_rows, n_values, n_different).

    The tables arrive in five steps: the first half of the loads, each load of the rest in two halves, one load
    withdrawn, and that load again; so counts are added, taken back and mended.
    """
    path = f"{shared_dir(spark)}/helixmill-stores/increments-{uuid.uuid4().hex}"
    tables = {t: table(spark, root, t).select("row_id", "load_id", *columns) for t, columns in PROFILED.items()}
    loads = sorted(r[0] for r in tables["clinical"].select("load_id").filter("load_id IS NOT NULL").distinct().collect())
    half, last = loads[len(loads) // 2] if loads else 0, loads[-1] if loads else 0
    steps = [f"load_id < {half}", f"load_id < {half} OR load_id < {last} AND row_id % 2 = 0", f"load_id < {last}", f"load_id <> {half} OR load_id IS NULL", "true"]
    for step in steps:
        grown = value_counts.maintain(spark, path, {t: (df.filter(step), PROFILED[t]) for t, df in tables.items()})
    made = value_counts.apply_deltas(None, [value_counts.delta(df, t, PROFILED[t]) for t, df in tables.items()])
    signed = grown.withColumn("grown", F.col("cnt")).withColumn("made", F.lit(0)).unionByName(made.withColumn("grown", F.lit(0)).withColumn("made", F.col("cnt")))
    both = signed.groupBy(*value_counts.KEYS, "value", "text").agg(F.sum("grown").alias("grown"), F.sum("made").alias("made"))
    return both.groupBy("table_name", "column_name").agg(F.sum("grown").alias("n_rows"), F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("grown") != F.col("made")).alias("n_different"))


def expression_spec(spark: SparkSession, root: str) -> wide_table.WideSpec:
    genes = wide_table.attribute_names(table(spark, root, "gene_mapping"), "ensembl")
    return wide_table.WideSpec("sample_id", "gene_id", "expression_value", genes, order=("measured_at", "loaded_at"))


def expression_wide(spark: SparkSession, root: str) -> DataFrame:
    wide = wide_table.to_wide(table(spark, root, "gene_expression"), expression_spec(spark, root))
    return wide_table.name_entities(wide, table(spark, root, "sample_registry"), "sample_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return wide_table.competing_cells(expression_wide(spark, root), "sample_id", "gene_id")


def p3_wide(spark: SparkSession, root: str) -> DataFrame:
    wide = expression_wide(spark, root)
    return wide.withColumn("competing", F.array_join("competing", ","))


def p3_signatures(spark: SparkSession, root: str) -> DataFrame:
    return wide_table.signature_report(wide_table.entities(wide_table.cells(table(spark, root, "gene_expression"), expression_spec(spark, root))))


def usable_age() -> Column:
    return fill.usable_number(F.col("age"), 0.0, 120.0, low_open=True)


def usable_stage() -> Column:
    return fill.stage_of(F.col("stage"))


def usable_tp53() -> Column:
    return fill.usable_number(F.col("TP53"), 0.0)


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with the patient's key and the usable stage, worked out once for all passes."""
    return durable(rows.withColumn("_patient", fill.subject_key("patient_id")).withColumn("_stage", usable_stage()))


def fill_stage(rows: DataFrame) -> DataFrame:
    return fill.fill_category(rows, "stage", F.col("_stage"), fill.STAGES, ["site", "load_id", "treatment_response"], F.col("_patient"), numbers=["survival_months", "age"])


def fill_age(rows: DataFrame) -> DataFrame:
    return fill.fill_number(rows, "age", usable_age(), ["site", "stage", "load_id"], F.col("_patient"), low=0.5, high=120.0)


def fill_both(rows: DataFrame) -> DataFrame:
    """Ages are filled with the filled stages among their groups, so these are written before."""
    return fill_age(durable(fill_stage(prepared(rows)))).drop("_patient", "_stage")


def fill_tp53(rows: DataFrame, clinical: DataFrame) -> DataFrame:
    """The site and stage of a row are those of its patient in ``clinical``."""
    keyed = rows.withColumn("_patient", fill.subject_key("patient_id"))
    grouped = durable(fill.with_groups_of(keyed, clinical.select("patient_id", "site", usable_stage().alias("stage")), F.col("_patient"), "patient_id", ["site", "stage"]))
    return fill.fill_number(grouped, "TP53", usable_tp53(), ["_site", "_stage", "load_id"], F.col("_patient"), log=True, low=0.0).drop("_patient", "_site", "_stage")


def p3_cells(spark: SparkSession, root: str) -> DataFrame:
    """The wide table turned back: (sample_id, gene_id, value) of every cell with a value."""
    wide = expression_wide(spark, root)
    return to_long(wide, "sample_id", [c for c in wide.columns if c not in ("sample_id", "competing")]).filter("value IS NOT NULL").select("sample_id", F.col("feature").alias("gene_id"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


def filled_clinical(spark: SparkSession, root: str) -> DataFrame:
    return fill_both(table(spark, root, "demo_clinical_data"))


def filled_expression(spark: SparkSession, root: str) -> DataFrame:
    return fill_tp53(table(spark, root, "demo_expression_data"), table(spark, root, "demo_clinical_data"))


def hold_outs(spark: SparkSession, root: str) -> DataFrame:
    """Errors of filling every fifth usable value from the others, beside those of the mean or most frequent class."""
    clinical, expression, hidden = table(spark, root, "demo_clinical_data"), table(spark, root, "demo_expression_data"), F.col("row_id") % 5 == 0
    parts = {
        "demo_clinical_data": [fill.hold_out(clinical, "age", usable_age(), hidden, fill_both), fill.hold_out(clinical, "stage", usable_stage(), hidden, lambda df: fill_stage(prepared(df)))],
        "demo_expression_data": [fill.hold_out(expression, "TP53", usable_tp53(), hidden, lambda df: fill_tp53(df, clinical), log=True)],
    }
    return reduce(DataFrame.unionByName, [p.select(F.lit(t).alias("table_name"), "*") for t, ps in parts.items() for p in ps])


def p4_holdout(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, column_name, n_hidden, baseline_error, better): whether filling beats the baseline on hidden values."""
    return hold_outs(spark, root).select("table_name", "column_name", "n_hidden", (F.round("baseline_error", 6) + F.lit(0.0)).alias("baseline_error"), (F.col("error") < F.col("baseline_error")).alias("better"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return fill.filled_cells([("demo_clinical_data", filled_clinical(spark, root), ["age", "stage"]), ("demo_expression_data", filled_expression(spark, root), ["TP53"])])


def p4_filled_clinical(spark: SparkSession, root: str) -> DataFrame:
    return filled_clinical(spark, root)


def p4_filled_expression(spark: SparkSession, root: str) -> DataFrame:
    return filled_expression(spark, root)


def references(spark: SparkSession, root: str) -> list[orphans.Reference]:
    clinical, demo = table(spark, root, "clinical"), table(spark, root, "demo_clinical_data")
    return [
        orphans.Reference("clinical", clinical, "sample_id", table(spark, root, "sample_registry"), "sample_id"),
        orphans.Reference("demo_clinical_data", demo, "patient_id", clinical, "patient_id"),
        orphans.Reference("demo_expression_data", table(spark, root, "demo_expression_data"), "patient_id", demo, "patient_id"),
    ]


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_rows(references(spark, root)).select("table_name", "row_id")


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_report(references(spark, root))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_columns, p2_increments, p3_found, p3_wide, p3_cells, p3_signatures, p4_found, p4_filled_clinical, p4_filled_expression, p4_holdout, p5_found, p5_report)}

_KEY = "upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_SET = "{0} IS NOT NULL AND regexp_matches({0}, '[^\\s\\p{{Z}}]')"


def _orphan_part(child: str, column: str, parent: str, parent_column: str) -> str:
    c, p = _KEY.format(f"c.{column}"), _KEY.format(f"p.{parent_column}")
    return f"""SELECT '{child}' AS table_name, c.row_id, '{column}' AS column_name, c.loaded_at FROM {child} c
      WHERE {_SET.format(f"c.{column}")} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {_SET.format(f"p.{parent_column}")} AND {p} <> '' AND {p} = {c}
        AND p.loaded_at <= c.loaded_at AND (p.retracted_at IS NULL OR p.retracted_at > c.loaded_at))"""


_ORPHANS = " UNION ALL ".join([
    _orphan_part("clinical", "sample_id", "sample_registry", "sample_id"),
    _orphan_part("demo_clinical_data", "patient_id", "clinical", "patient_id"),
    _orphan_part("demo_expression_data", "patient_id", "demo_clinical_data", "patient_id"),
])

_PROFILE = """
v AS (SELECT 'clinical' AS table_name, 'age' AS column_name, load_id, CASE WHEN isnan(age) THEN NULL ELSE age END AS v, 0.0 AS low, 120.0 AS high FROM clinical
  UNION ALL SELECT 'clinical', 'tumor_size', load_id, CASE WHEN isnan(tumor_size) THEN NULL ELSE tumor_size END, 0.0, 300.0 FROM clinical
  UNION ALL SELECT 'demo_expression_data', 'BRCA1', load_id, CASE WHEN isnan("BRCA1") THEN NULL ELSE "BRCA1" END, 0.0, 1e308 FROM demo_expression_data),
t AS (SELECT table_name, column_name, load_id, max(n) AS n_top, sum(n * log2(n)) AS clog FROM (SELECT table_name, column_name, load_id, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
m AS (SELECT table_name, column_name, load_id, count(*) AS n_rows, (count(*) - count(v)) / count(*) AS missing_share,
    count(*) FILTER (v < low OR v > high) / count(*) AS invalid_share, count(DISTINCT v) AS n_distinct, min(v) AS min_value, max(v) AS max_value, count(v) AS present,
    quantile_cont(v, 0.5) FILTER (v BETWEEN low AND high) AS median,
    quantile_cont(v, 0.75) FILTER (v BETWEEN low AND high) - quantile_cont(v, 0.25) FILTER (v BETWEEN low AND high) AS iqr FROM v GROUP BY ALL),
j AS (SELECT m.*, coalesce(n_top, 0) / n_rows AS top_share, CASE WHEN present > 0 THEN log2(present) - clog / present END AS entropy_bits FROM m LEFT JOIN t USING (table_name, column_name, load_id)),
u AS (SELECT table_name, column_name, median(missing_share) AS a, median(invalid_share) AS b, median(top_share) AS c, median(median) AS d, median(iqr) AS e FROM j GROUP BY ALL),
d AS (SELECT j.*, coalesce(abs(missing_share - a) > 0.15, false) OR coalesce(abs(invalid_share - b) > 0.15, false) OR coalesce(abs(top_share - c) > 0.20, false)
    OR coalesce(abs(median) > abs(d) * 1.5 OR abs(median) * 1.5 < abs(d) OR sign(median) * sign(d) < 0, false) OR coalesce(abs(iqr) > abs(e) * 2.0 OR abs(iqr) * 2.0 < abs(e), false) AS differs
  FROM j JOIN u USING (table_name, column_name))"""

_COLUMNS = {  # type by column: number or text
    "clinical": {"row_id": "n", "patient_id": "t", "sample_id": "t", "age": "n", "gender": "t", "tumor_stage": "t", "tumor_grade": "t", "tumor_size": "n", "lymph_nodes": "n", "survival_time": "n", "vital_status": "t", "recorded_at": "d", "loaded_at": "d", "retracted_at": "d"},
    "demo_expression_data": {"row_id": "n", "patient_id": "t", "TP53": "n", "BRCA1": "n", "EGFR": "n", "KRAS": "n", "PTEN": "n", "loaded_at": "d"},
}


def _column_sql(t: str, c: str, kind: str) -> str:
    low, high = RANGES.get(c, (None, None))
    inside = " AND ".join([f"v >= {low}"] * (low is not None) + [f"v <= {high}"] * (high is not None)) or "true"
    number = f'CASE WHEN isnan("{c}"::DOUBLE) THEN NULL ELSE "{c}"::DOUBLE END' if kind == "n" else "NULL::DOUBLE"
    # a timestamp as the engine writes it: without zeros at the end of the fraction
    stamp = f"regexp_replace(regexp_replace(strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '[.]$', '')" if kind == "d" else f'"{c}"'
    text = "NULL::VARCHAR" if kind == "n" else stamp
    good = f"regexp_matches(x, '{PATTERNS[c]}')" if c in PATTERNS else inside if kind == "n" else "true"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, v, x, coalesce({good}, true) AS ok FROM (SELECT load_id, {number} AS v, {text} AS x FROM {t})"


_EVERY = f"""a AS ({" UNION ALL ".join(_column_sql(t, c, k) for t, cs in _COLUMNS.items() for c, k in cs.items())}),
  k AS (SELECT table_name, column_name, load_id, coalesce(v::VARCHAR, x) AS y, count(*) AS n FROM a WHERE v IS NOT NULL OR x IS NOT NULL GROUP BY ALL),
  g AS (SELECT table_name, column_name, y, sum(n) AS m FROM k GROUP BY ALL), gt AS (SELECT table_name, column_name, sum(n) AS mm FROM k GROUP BY ALL), kt AS (SELECT table_name, column_name, load_id, sum(n) AS nn, max(n) AS n_top, sum(n * log2(n)) AS clog FROM k GROUP BY ALL),
  h AS (SELECT table_name, column_name, load_id, (sum(abs(n / nn - m / mm)) + 1 - sum(m / mm)) / 2 AS shift FROM k JOIN g USING (table_name, column_name, y) JOIN gt USING (table_name, column_name) JOIN kt USING (table_name, column_name, load_id) GROUP BY ALL),
  s AS (SELECT table_name, column_name, load_id, count(*) AS n_rows, count(*) FILTER (v IS NULL AND x IS NULL) / count(*) AS missing_share, count(*) FILTER ((v IS NOT NULL OR x IS NOT NULL) AND NOT ok) / count(*) AS invalid_share,
    count(DISTINCT coalesce(v::VARCHAR, x)) AS n_distinct, min(v) AS min_value, max(v) AS max_value, min(x) AS min_text, max(x) AS max_text, quantile_cont(v, 0.5) FILTER (ok) AS median, quantile_cont(v, 0.75) FILTER (ok) - quantile_cont(v, 0.25) FILTER (ok) AS iqr FROM a GROUP BY ALL)"""

_STAGE = "regexp_replace(strip_accents(lower(stage)), '[^a-z0-9Ⅰ-Ⅳⅰ-ⅳ]', '', 'g')"
_STAGE_OK = f"regexp_matches({_STAGE}, '^(ajcc|uicc|figo|tnm)?([pc]?(stage|stadium|stade|estadio|stadio|stad|stg|st))?(iv|i{{1,3}}|[1-4]|one|two|three|four|[Ⅰ-Ⅳⅰ-ⅳ])([abc][0-9]?)?$')"

_STAGE_CORE = f"regexp_extract({_STAGE}, '^(ajcc|uicc|figo|tnm)?([pc]?(stage|stadium|stade|estadio|stadio|stad|stg|st))?(iv|i{{1,3}}|[1-4]|one|two|three|four|[Ⅰ-Ⅳⅰ-ⅳ])([abc][0-9]?)?$', 4)"

_GENE_KEY = "upper(regexp_replace(split_part(trim(gene_id), '.', 1), '[^A-Za-z0-9]+', '', 'g'))"
_CELLS = f"""SELECT {_KEY.format('sample_id')} AS s, upper(regexp_replace(split_part(trim(gene_id), '.', 1), '[^A-Za-z0-9]+', '', 'g')) AS g, expression_value AS v
  FROM gene_expression WHERE expression_value >= 0 AND NOT isnan(expression_value)"""

ORACLE = {
    "p2_found": f"WITH {_PROFILE} SELECT table_name, column_name, load_id FROM d WHERE differs",
    "p2_profile": f"""WITH {_PROFILE} SELECT table_name, column_name, load_id, n_rows, round(missing_share, 6) AS missing_share, round(invalid_share, 6) AS invalid_share, n_distinct,
      round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, round(top_share, 6) AS top_share, round(median, 6) AS median, round(iqr, 6) AS iqr, round(entropy_bits, 6) AS entropy_bits, differs FROM d""",
    "p2_columns": f"""WITH {_EVERY} SELECT table_name, column_name, load_id, n_rows, round(missing_share, 6) + 0.0 AS missing_share, round(invalid_share, 6) + 0.0 AS invalid_share, n_distinct, round(min_value, 6) + 0.0 AS min_value,
      round(max_value, 6) + 0.0 AS max_value, min_text, max_text, round(coalesce(n_top, 0) / n_rows, 6) + 0.0 AS top_share, round(median, 6) + 0.0 AS median, round(iqr, 6) + 0.0 AS iqr, round(log2(nn) - clog / nn, 6) + 0.0 AS entropy_bits, round(shift, 6) + 0.0 AS shift
      FROM s LEFT JOIN kt USING (table_name, column_name, load_id) LEFT JOIN h USING (table_name, column_name, load_id)""",
    "p2_increments": f"""WITH {_PROFILE} SELECT table_name, column_name, sum(n)::BIGINT AS n_rows, count(*) AS n_values, 0::BIGINT AS n_different FROM (SELECT table_name, column_name, load_id, v, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL""",
    "p3_found": f"""SELECT r.sample_id, m.ensembl AS gene_id FROM (SELECT s, g FROM ({_CELLS}) GROUP BY s, g HAVING max(v) - min(v) > 0.001) x
      JOIN sample_registry r ON {_KEY.format('r.sample_id')} = x.s JOIN gene_mapping m ON upper(m.ensembl) = x.g""",
    "p3_cells": f"""WITH c AS (SELECT {_KEY.format('sample_id')} AS s, {_GENE_KEY} AS g, expression_value AS v, measured_at, loaded_at FROM gene_expression WHERE expression_value >= 0 AND NOT isnan(expression_value)),
      n AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY measured_at DESC NULLS LAST, loaded_at DESC NULLS LAST, v) AS i FROM c)
      SELECT r.sample_id, m.ensembl AS gene_id, round(n.v, 6) + 0.0 AS value FROM n JOIN sample_registry r ON {_KEY.format('r.sample_id')} = n.s JOIN gene_mapping m ON upper(m.ensembl) = n.g WHERE i = 1""",
    "p3_signatures": f"""WITH c AS (SELECT DISTINCT {_KEY.format('sample_id')} AS s, m.ensembl AS g FROM gene_expression JOIN gene_mapping m ON upper(m.ensembl) = {_GENE_KEY} WHERE {_KEY.format('sample_id')} <> ''),
      e AS (SELECT s, list_sort(list(g)) AS sig FROM c GROUP BY s), k AS (SELECT sig, count(*) AS n FROM e GROUP BY sig)
      SELECT count(*) AS n_signatures, sum(n)::BIGINT AS n_entities, max(n) AS largest, max(len(sig))::INT AS most_attributes FROM k""",
    "p4_found": f"""SELECT 'demo_clinical_data' AS table_name, row_id, 'age' AS column_name FROM demo_clinical_data WHERE age IS NULL OR isnan(age) OR age <= 0 OR age > 120
      UNION ALL SELECT 'demo_clinical_data', row_id, 'stage' FROM demo_clinical_data WHERE stage IS NULL OR NOT {_STAGE_OK}
      UNION ALL SELECT 'demo_expression_data', row_id, 'TP53' FROM demo_expression_data WHERE "TP53" IS NULL OR isnan("TP53") OR "TP53" < 0""",
    "p4_holdout": f"""WITH u AS (SELECT 'demo_clinical_data' AS table_name, 'age' AS column_name, row_id, age AS v FROM demo_clinical_data WHERE age > 0 AND age <= 120 AND NOT isnan(age)
        UNION ALL SELECT 'demo_expression_data', 'TP53', row_id, ln(1 + "TP53") FROM demo_expression_data WHERE "TP53" >= 0 AND NOT isnan("TP53")),
      m AS (SELECT table_name, column_name, avg(v) AS mean FROM u WHERE row_id % 5 <> 0 GROUP BY ALL),
      s AS (SELECT row_id, {_STAGE_CORE} AS c FROM demo_clinical_data WHERE {_STAGE_OK}),
      t AS (SELECT row_id, CASE WHEN c IN ('iv', '4', 'four', 'Ⅳ', 'ⅳ') THEN 'IV' WHEN c IN ('iii', '3', 'three', 'Ⅲ', 'ⅲ') THEN 'III' WHEN c IN ('ii', '2', 'two', 'Ⅱ', 'ⅱ') THEN 'II' ELSE 'I' END AS c FROM s),
      f AS (SELECT c FROM t WHERE row_id % 5 <> 0 GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
      SELECT table_name, column_name, count(*) AS n_hidden, round(sqrt(avg((v - mean) * (v - mean))), 6) + 0.0 AS baseline_error, true AS better FROM u JOIN m USING (table_name, column_name) WHERE row_id % 5 = 0 GROUP BY ALL
      UNION ALL SELECT 'demo_clinical_data', 'stage', count(*), round(avg((t.c <> f.c)::INT), 6) + 0.0, true FROM t, f WHERE row_id % 5 = 0""",
    "p5_found": f"SELECT table_name, row_id FROM ({_ORPHANS})",
    "p5_report": f"""WITH o AS ({_ORPHANS}), r AS (SELECT 'clinical' AS table_name, 'sample_id' AS column_name, loaded_at FROM clinical WHERE {_SET.format('sample_id')}
      UNION ALL SELECT 'demo_clinical_data', 'patient_id', loaded_at FROM demo_clinical_data WHERE {_SET.format('patient_id')}
      UNION ALL SELECT 'demo_expression_data', 'patient_id', loaded_at FROM demo_expression_data WHERE {_SET.format('patient_id')}),
      oc AS (SELECT table_name, column_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n FROM o GROUP BY ALL),
      rc AS (SELECT table_name, column_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_references FROM r GROUP BY ALL)
      SELECT table_name, column_name, month, n_references, coalesce(n, 0) AS n_orphans FROM rc LEFT JOIN oc USING (table_name, column_name, month)""",
}
