"""Queries over quality control, statistics and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import quality, validate
from helixmill.plans import adapters as a
from helixmill.session import table
from helixmill.sources import exports

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COLS = [f"n{i}" for i in a.LINES]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R = "round({0}, 6) + 0.0"
_GAPS = " + ".join(f"({c} IS NULL)::INT" for c in COLS)


def _long(spark: SparkSession, root: str) -> DataFrame:
    return a.embedded(spark, root).select("sample", "feature", "value")


# --- missing values ----------------------------------------------------------------------
@query(f"WITH {a.SPARSE_LONG} SELECT feature AS column_name, count(*) FILTER (value IS NULL) AS n_missing, {R.format('count(*) FILTER (value IS NULL) * 100.0 / count(*)')} AS missing_percent FROM sparse_long GROUP BY ALL HAVING count(*) FILTER (value IS NULL) > 0")
def missing_report(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.missing_report(a.sparse(spark, root), COLS), ["missing_percent"])


@query(f"""WITH {a.SPARSE}, g AS (SELECT {_GAPS} AS g FROM sparse) SELECT count(*) AS n_rows, count(*) * 7 AS n_cells, sum(g)::BIGINT AS n_missing, {R.format('sum(g) * 100.0 / (count(*) * 7)')} AS missing_percent,
    count(*) FILTER (g > 0) AS rows_with_missing, count(*) FILTER (g = 0) AS complete_rows, {R.format('count(*) FILTER (g = 0) * 100.0 / count(*)')} AS complete_percent FROM g""")
def missing_rows(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.missing_summary(a.sparse(spark, root), COLS), ["missing_percent", "complete_percent"])


@query(f"WITH {a.SPARSE} SELECT {_GAPS} AS n_missing, count(*) AS n_rows FROM sparse GROUP BY ALL ORDER BY n_rows DESC, n_missing LIMIT 10")
def missing_patterns(spark: SparkSession, root: str) -> DataFrame:
    return quality.missing_patterns(a.sparse(spark, root), COLS)


@query(f"WITH {a.SPARSE} SELECT sample, {R.format(f'(1 - ({_GAPS}) / 7.0) * 100')} AS completeness_percent FROM sparse")
def sample_completeness(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.completeness(a.sparse(spark, root), "sample", COLS), ["completeness_percent"])


# --- shape, duplicates, statistics -------------------------------------------------------
_ITEMS = "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem"


@query(f"SELECT sum(n)::BIGINT AS n_rows, 3 AS n_columns, 2 AS numeric_columns, 1 AS text_columns, sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM ({_ITEMS}) GROUP BY l_orderkey, l_linenumber, l_returnflag)")
def basic_metrics(spark: SparkSession, root: str) -> DataFrame:
    return quality.basic_metrics(table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def id_uniqueness(spark: SparkSession, root: str) -> DataFrame:
    return quality.duplicated_ids(table(spark, root, "orders"), "o_custkey")


_NUM = """SELECT '{0}' AS column_name, '{1}' AS data_type, count(*) FILTER ({0} IS NULL) AS n_missing, count(*) FILTER ({0} IS NULL) * 100.0 / count(*) AS missing_percent, round(min({0})::DOUBLE, 4) + 0.0 AS min, round(max({0})::DOUBLE, 4) + 0.0 AS max,
  round(avg({0}), 4) + 0.0 AS mean, round(median({0}), 4) + 0.0 AS median, round(stddev_samp({0}), 4) + 0.0 AS std, count(DISTINCT {0}) AS n_unique, NULL::VARCHAR AS top FROM customer"""
_TXT = """SELECT '{0}', 'string', count(*) FILTER ({0} IS NULL), count(*) FILTER ({0} IS NULL) * 100.0 / count(*), NULL, NULL, NULL, NULL, NULL, count(DISTINCT {0}),
  (SELECT string_agg({0} || ':' || n, ',' ORDER BY n DESC, {0}) FROM (SELECT {0}, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, {0} LIMIT 5)) FROM customer"""


@query(" UNION ALL ".join([_NUM.format("c_custkey", "bigint"), _NUM.format("c_nationkey", "int"), _NUM.format("c_acctbal", "double"), _TXT.format("c_name"), _TXT.format("c_mktsegment")]))
def column_stats(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(exports.column_statistics(table(spark, root, "customer")), ["min", "max", "mean", "median", "std"], 4)


@query("""SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INT AS rank FROM (
    SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL)) WHERE rank <= 5""")
def top_values(spark: SparkSession, root: str) -> DataFrame:
    return quality.top_values(table(spark, root, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_DESC = ", ".join(f"round({e}, 4) + 0.0 AS {n}" for e, n in (("avg(value)", "mean"), ("stddev_samp(value)", "std"), ("min(value)", "min"), ("quantile_cont(value, 0.25)", "q25"), ("quantile_cont(value, 0.5)", "q50"), ("quantile_cont(value, 0.75)", "q75"), ("max(value)", "max")))


@query(f"SELECT feature, count(value) AS n, {_DESC} FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem) GROUP BY ALL")
def describe_numeric(spark: SparkSession, root: str) -> DataFrame:
    from helixmill.operators.matrix import to_long

    long = to_long(table(spark, root, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount"])
    return a.tidy(quality.describe(long), ["mean", "std", "min", "q25", "q50", "q75", "max"], 4)


_MOMENTS = """m2 AS (SELECT {k} count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, {extra} avg(d * d) AS v2, avg(d * d * d) AS v3, avg(d * d * d * d) AS v4
  FROM (SELECT *, value - avg(value) OVER ({w}) AS d FROM emb WHERE value IS NOT NULL) {g})"""
_SKEW = "round(v3 / pow(v2, 1.5), 4) + 0.0 AS skewness, round(v4 / (v2 * v2) - 3, 4) + 0.0 AS kurtosis"


@query(f"WITH {a.EMB}, {_MOMENTS.format(k='feature,', extra='median(value) AS median, stddev_samp(value) AS std,', w='PARTITION BY feature', g='GROUP BY feature')} SELECT feature, n, round(mean, 4) + 0.0 AS mean, round(median, 4) + 0.0 AS median, round(std, 4) + 0.0 AS std, {_SKEW}, round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max FROM m2")
def distribution_stats(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.distributions(_long(spark, root)), ["mean", "median", "std", "skewness", "kurtosis", "min", "max"], 4)


@query(f"WITH {a.EMB}, {_MOMENTS.format(k='', extra='stddev_pop(value) AS std,', w='', g='')} SELECT n, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std, {_SKEW}, round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max FROM m2")
def distribution_overall(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.overall_distribution(_long(spark, root)), ["mean", "std", "skewness", "kurtosis", "min", "max"], 4)


# --- correlation -------------------------------------------------------------------------
_PAIRS = f"{a.EMB}, pairs AS (SELECT x.feature AS feature_a, y.feature AS feature_b, corr(x.value, y.value) AS r, count(*) AS n FROM emb x JOIN emb y ON x.sample = y.sample AND x.feature < y.feature GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT feature_a, feature_b, round(r, 5) + 0.0 AS r, n FROM pairs")
def corr_matrix(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.correlations(_long(spark, root)), ["r"], 5)


@query(f"WITH {_PAIRS} SELECT feature_a, feature_b, round(r, 5) + 0.0 AS r, n FROM pairs WHERE abs(r) > 0.1")
def high_corr_pairs(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.high_correlations(quality.correlations(_long(spark, root)), 0.1), ["r"], 5)


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (abs(r) > 0.1) AS n_high, round(max(abs(r)), 5) + 0.0 AS max_abs_r, round(avg(abs(r)), 5) + 0.0 AS mean_abs_r FROM pairs")
def corr_summary(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.correlation_summary(quality.correlations(_long(spark, root)), 0.1), ["max_abs_r", "mean_abs_r"], 5)


_TWO = """c AS (SELECT var_samp(embedding[1]::DOUBLE) AS a, var_samp(embedding[2]::DOUBLE) AS d, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS b FROM embeddings),
  l AS (SELECT (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS hi, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS lo FROM c)"""


@query(f"WITH {_TWO} SELECT unnest(['condition_number', 'first_to_second']) AS metric, {R.format('hi / lo')} AS value FROM l")
def eigen_metrics_pair(spark: SparkSession, root: str) -> DataFrame:
    """Of two features, whose eigenvalues have a closed form."""
    from helixmill.operators.reduce import spectrum

    found = spectrum(a.embedded_wide(spark, root), ["d00", "d01"])
    return a.tidy(spark.createDataFrame([(k, v) for k, v in found.items()], "metric string, value double"), ["value"])


@query()
def eigen_metrics(spark: SparkSession, root: str) -> DataFrame:
    from helixmill.operators.reduce import spectrum

    found = spectrum(a.embedded_wide(spark, root), [f"d{i:02d}" for i in range(a.DIMS)])
    return spark.createDataFrame([(k, v) for k, v in found.items()], "metric string, value double")


# --- groups and tests --------------------------------------------------------------------
@query(f"WITH {a.EMB} SELECT label, feature, {R.format('avg(value)')} AS mean, {R.format('stddev_samp(value)')} AS std, count(value) AS n FROM emb GROUP BY ALL HAVING count(value) > 1")
def batch_group_stats(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.batch_stats(a.embedded(spark, root), "label"), ["mean", "std"])


_KW = """r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM emb),
  g AS (SELECT feature, label, sum(rk) AS s, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM emb GROUP BY ALL) GROUP BY ALL),
  k AS (SELECT feature, sum(n)::BIGINT AS n, count(*) AS groups, (12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) AS h, sum(n)::DOUBLE AS nn FROM g GROUP BY ALL)"""


@query(f"WITH {a.EMB}, {_KW} SELECT feature, n, groups, round(h / (1 - ties / (nn * nn * nn - nn)), 4) + 0.0 AS h FROM k JOIN t USING (feature)")
def kruskal_statistic(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.kruskal(a.embedded(spark, root), "label").drop("p_value"), ["h"], 4)


@query()
def batch_effect(spark: SparkSession, root: str) -> DataFrame:
    return quality.batch_effect(quality.kruskal(a.embedded(spark, root), "label"))


@query(f"""WITH {a.EMB}, s AS (SELECT feature, avg(value) FILTER (label = 0) AS ma, avg(value) FILTER (label = 1) AS mb, var_samp(value) FILTER (label = 0) / count(*) FILTER (label = 0) AS ea, var_samp(value) FILTER (label = 1) / count(*) FILTER (label = 1) AS eb,
    count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb FROM emb GROUP BY ALL) SELECT feature, round((ma - mb) / sqrt(ea + eb), 5) + 0.0 AS t, round((ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 4) + 0.0 AS df FROM s""")
def two_group_t(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(a.tidy(quality.two_groups(a.embedded(spark, root), "label", 0, 1).drop("p_value"), ["t"], 5), ["df"], 4)


@query(f"""WITH {a.EMB}, two AS (SELECT * FROM emb WHERE label IN (0, 1)), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM two)
    SELECT feature, sum(rk) FILTER (label = 0) - count(*) FILTER (label = 0) * (count(*) FILTER (label = 0) + 1) / 2 AS u FROM r GROUP BY ALL""")
def mann_whitney_u(spark: SparkSession, root: str) -> DataFrame:
    return quality.mann_whitney(a.embedded(spark, root), "label", 0, 1).select("feature", "u")


@query()
def normality_tests(spark: SparkSession, root: str) -> DataFrame:
    return quality.normality(_long(spark, root))


# --- expression quality ------------------------------------------------------------------
_GENE = f"{a.COUNTS}, g AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / avg(value) AS cv FROM counts GROUP BY ALL), gq AS (SELECT *, mean < (SELECT quantile_cont(mean, 0.25) FROM g) AS low, coalesce(cv > (SELECT quantile_cont(cv, 0.9) FROM g), false) AS variable FROM g)"
_LIB = "l AS (SELECT sample, sum(value) AS library_size FROM counts GROUP BY ALL), q AS (SELECT quantile_cont(library_size, 0.25) AS q1, quantile_cont(library_size, 0.75) AS q3 FROM l), lq AS (SELECT sample, library_size, library_size < q1 - 1.5 * (q3 - q1) OR library_size > q3 + 1.5 * (q3 - q1) AS unusual FROM l, q)"


@query(f"WITH {_GENE} SELECT feature, {R.format('mean')} AS mean, {R.format('std')} AS std, {R.format('cv')} AS cv, low, variable FROM gq")
def expression_gene_qc(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.gene_quality(a.counts(spark, root)), ["mean", "std", "cv"])


@query(f"WITH {a.COUNTS}, {_LIB} SELECT sample, {R.format('library_size')} AS library_size, unusual FROM lq")
def expression_library_qc(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.library_quality(a.counts(spark, root)), ["library_size"])


@query(f"""WITH {_GENE}, {_LIB} SELECT (SELECT count(*) FROM gq) AS n_genes, (SELECT count(*) FILTER (low) FROM gq) AS n_low, (SELECT {R.format('count(*) FILTER (low) * 100.0 / count(*)')} FROM gq) AS low_percent,
    (SELECT count(*) FILTER (variable) FROM gq) AS n_variable, (SELECT {R.format('avg(cv)')} FROM gq) AS mean_cv, count(*) AS n_samples, {R.format('avg(library_size)')} AS mean_library, {R.format('stddev_samp(library_size)')} AS std_library, {R.format('count(*) FILTER (unusual) * 100.0 / count(*)')} AS unusual_percent FROM lq""")
def expression_qc_summary(spark: SparkSession, root: str) -> DataFrame:
    long = a.counts(spark, root)
    out = quality.expression_summary(quality.gene_quality(long), quality.library_quality(long))
    return a.tidy(out, ["low_percent", "mean_cv", "mean_library", "std_library", "unusual_percent"])


@query()
def qc_verdict(spark: SparkSession, root: str) -> DataFrame:
    from helixmill.operators.matrix import to_wide

    counts = to_wide(a.counts(spark, root), "sample", "feature", "value", a.BRANDS)
    return quality.modality_report("counts", counts, "sample").unionByName(quality.modality_report("events", a.event_wide(spark, root), "sample"))


# --- outliers ----------------------------------------------------------------------------
_IQR = f"{a.EMB}, s AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM emb GROUP BY ALL), bad AS (SELECT DISTINCT sample FROM emb JOIN s USING (feature) WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5)"


@query(f"WITH {_IQR} SELECT sample FROM bad")
def outliers_iqr(spark: SparkSession, root: str) -> DataFrame:
    return quality.outliers(_long(spark, root))


@query(f"WITH {a.EMB}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM emb GROUP BY ALL) SELECT DISTINCT sample FROM emb JOIN s USING (feature) WHERE abs(value - m) > 3 * s")
def outliers_zscore(spark: SparkSession, root: str) -> DataFrame:
    return quality.outliers(_long(spark, root), "zscore")


@query(f"WITH {_IQR} SELECT vec_id AS sample, label FROM embeddings WHERE vec_id NOT IN (SELECT sample FROM bad)")
def remove_outliers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    return quality.remove_rows(rows, quality.outliers(_long(spark, root)), "sample")


# --- distributions of columns and classes ------------------------------------------------
@query("SELECT least(floor((c_acctbal - a) / ((b - a) / 30)) + 1, 30)::BIGINT AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) GROUP BY ALL")
def histogram_1d(spark: SparkSession, root: str) -> DataFrame:
    return quality.histogram(table(spark, root, "customer"), "c_acctbal", 30)


@query("""SELECT least(floor((l_quantity - xa) / ((xb - xa) / 30)) + 1, 30)::BIGINT AS bin_x, least(floor((l_extendedprice - ya) / ((yb - ya) / 30)) + 1, 30)::BIGINT AS bin_y, count(*) AS n
    FROM lineitem, (SELECT min(l_quantity) AS xa, max(l_quantity) AS xb, min(l_extendedprice) AS ya, max(l_extendedprice) AS yb FROM lineitem) GROUP BY ALL""")
def histogram_2d(spark: SparkSession, root: str) -> DataFrame:
    return quality.histogram_2d(table(spark, root, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT label, count(*) AS n, (SELECT round(min(n) / max(n), 6) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS balance FROM embeddings GROUP BY label")
def class_balance(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.class_balance(table(spark, root, "embeddings"), "label"), ["balance"])


@query(f"""WITH {a.EMB}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi, count(*) FILTER (value = 0) AS z, count(*) AS c FROM emb GROUP BY ALL)
    SELECT {R.format('avg(m)')} AS mean_of_means, {R.format('avg(s)')} AS mean_of_std, {R.format('min(lo)')} AS min, {R.format('max(hi)')} AS max, {R.format('sum(z) / sum(c)')} AS sparsity FROM s""")
def ml_quality(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.matrix_quality(_long(spark, root)), ["mean_of_means", "mean_of_std", "min", "max", "sparsity"])


@query(f"WITH {a.EMB_GAPS} SELECT {R.format('avg((value IS NULL OR value <> 0)::INT)')} AS density FROM emb")
def feature_density(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(quality.density(a.embedded(spark, root, gaps=True)), ["density"])


# --- validation --------------------------------------------------------------------------
def _range_sql(column: str, low: float, high: float) -> str:
    x = f"CASE WHEN isnan({column}) THEN NULL ELSE {column} END"
    return f"SELECT '{column}' AS column_name, count(*) FILTER (({x}) < {low} OR ({x}) > {high}) AS n_outside, min({x}) AS actual_min, max({x}) AS actual_max, count(*) FILTER (({x}) < {low} OR ({x}) > {high}) = 0 AS valid FROM clinical"


@query(" UNION ALL ".join(_range_sql(c, *r) for c, r in {"age": (0, 120), "tumor_size": (0, 300), "survival_time": (0, 600)}.items()))
def validation_ranges(spark: SparkSession, root: str) -> DataFrame:
    return validate.range_report(table(spark, root, "clinical"), {"age": (0, 120), "tumor_size": (0, 300), "survival_time": (0, 600)})


def _schema_sql() -> str:
    parts = []
    for c, f in validate.SCHEMAS["clinical"].items():
        if not f.nullable:
            parts.append((c, "null", f"{c} IS NULL"))
        if f.low is not None:
            parts.append((c, "range", f"{c} < {f.low}"))
        if f.allowed is not None:
            parts.append((c, "allowed", f"{c} NOT IN ({', '.join(repr(x) for x in f.allowed)})"))
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{n}' AS \"check\", count(*) FILTER ({p}) AS n_failed FROM clinical" for c, n, p in parts)


@query(_schema_sql())
def validation_schema(spark: SparkSession, root: str) -> DataFrame:
    return validate.violations(table(spark, root, "clinical"), validate.SCHEMAS["clinical"])


_ALL = ["row_id", "patient_id", "sample_id", "age", "gender", "tumor_stage", "tumor_grade", "tumor_size", "lymph_nodes", "survival_time", "vital_status", "recorded_at", "load_id", "loaded_at", "retracted_at"]


@query(f"SELECT 100.0 AS coverage_percent, 100.0 AS type_percent, {R.format('m * 100')} AS missing_percent, {R.format('(0.8 + 0.2 * (1 - m)) * 100')} AS completeness_score FROM (SELECT avg({' + '.join(f'({c} IS NULL)::INT' for c in _ALL)}) / {len(_ALL)} AS m FROM clinical)")
def validation_score(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(validate.score(table(spark, root, "clinical"), validate.SCHEMAS["clinical"]), ["coverage_percent", "type_percent", "missing_percent", "completeness_score"])


@query("SELECT 'patient_id' AS column_name, count(*) FILTER (NOT regexp_matches(patient_id, '^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})')) AS n_invalid FROM clinical UNION ALL SELECT 'sample_id', count(*) FILTER (NOT regexp_matches(sample_id, '^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-[0-9]{2}[A-Z])')) FROM clinical")
def validation_formats(spark: SparkSession, root: str) -> DataFrame:
    return validate.format_report(table(spark, root, "clinical"), {"patient_id": "TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}", "sample_id": "TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-[0-9]{2}[A-Z]"})


@query()
def validation_summary(spark: SparkSession, root: str) -> DataFrame:
    return validate.validate_all({n: table(spark, root, n) for n in ("gene_expression", "clinical")})
