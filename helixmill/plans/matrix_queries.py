"""Queries over imputation, normalisation, scaling and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import impute, matrix, normalize
from helixmill.operators.learn import scale_by_train
from helixmill.plans import adapters as a
from helixmill.session import table

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


# --- reshaping ---------------------------------------------------------------------------
@query("SELECT l_orderkey AS sample, " + ", ".join(f"round(coalesce(avg(l_extendedprice) FILTER (l_linenumber = {i}), 0), 4) + 0.0 AS n{i}" for i in a.LINES) + " FROM lineitem GROUP BY ALL")
def pivot_mean_fill0(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("sample"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("feature"), F.col("l_extendedprice").alias("value"))
    return a.tidy(matrix.to_wide(rows, "sample", "feature", "value", [f"n{i}" for i in a.LINES], 0.0), [f"n{i}" for i in a.LINES], 4)


@query(f"WITH {a.EVENTS} SELECT sample, feature, {R.format('value')} AS value FROM (SELECT DISTINCT user_id AS sample FROM events) CROSS JOIN (SELECT DISTINCT event_type AS feature FROM events) LEFT JOIN ev USING (sample, feature)")
def unpivot_flatten(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(matrix.to_long(a.event_wide(spark, root), "sample"), ["value"])


@query(f"WITH {a.COUNTS} SELECT f.feature, s.sample, {R.format('value')} AS value FROM (SELECT DISTINCT p_brand AS feature FROM part) f CROSS JOIN (SELECT DISTINCT sample FROM counts) s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample")
def transpose_matrix(spark: SparkSession, root: str) -> DataFrame:
    wide = matrix.to_wide(a.counts(spark, root), "sample", "feature", "value", a.BRANDS)
    return a.tidy(matrix.transpose_long(wide, "sample", a.BRANDS), ["value"])


# --- imputation --------------------------------------------------------------------------
def _filled(spark: SparkSession, root: str, strategy: str) -> DataFrame:
    wide = matrix.to_wide(a.embedded(spark, root, gaps=True), "sample", "feature", "value", [f"d{i:02d}" for i in range(a.DIMS)])
    full = impute.fit_simple(wide, strategy, exclude=["sample"]).transform(wide)
    return a.tidy(matrix.to_long(full, "sample"), ["value"])


@query(f"WITH {a.EMB_GAPS} SELECT sample, feature, {R.format('coalesce(value, median(value) OVER (PARTITION BY feature))')} AS value FROM emb")
def impute_median(spark: SparkSession, root: str) -> DataFrame:
    return _filled(spark, root, "median")


@query(f"WITH {a.EMB_GAPS} SELECT sample, feature, {R.format('coalesce(value, avg(value) OVER (PARTITION BY feature))')} AS value FROM emb")
def impute_mean(spark: SparkSession, root: str) -> DataFrame:
    return _filled(spark, root, "mean")


@query(f"WITH {a.EMB_GAPS} SELECT sample, feature, {R.format('coalesce(value, -1)')} AS value FROM emb")
def impute_constant(spark: SparkSession, root: str) -> DataFrame:
    wide = matrix.to_wide(a.embedded(spark, root, gaps=True), "sample", "feature", "value", [f"d{i:02d}" for i in range(a.DIMS)])
    full = impute.fit_simple(wide, "constant", exclude=["sample"], constant=-1.0).transform(wide)
    return a.tidy(matrix.to_long(full, "sample"), ["value"])


_MODE = "(SELECT {0} FROM g WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@query(f"""WITH {a.CLINICAL}, g AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN r_name END AS region FROM cl)
    SELECT c_custkey, coalesce(segment, {_MODE.format('segment')}) AS segment, coalesce(region, {_MODE.format('region')}) AS region, 'Unknown' AS nothing FROM g""")
def impute_mode(spark: SparkSession, root: str) -> DataFrame:
    c = a.clinical_like(spark, root)
    gappy = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 7 != 0, F.col("r_name")).alias("region"), F.lit(None).cast("string").alias("nothing"))
    return impute.fit_simple(gappy, "median", columns=[], exclude=["c_custkey"]).transform(gappy)


def _knn_sql(value: str) -> str:
    return f"""WITH {a.EVENTS_GAPS},
      d AS (SELECT x.sample AS s, y.sample AS t, sqrt(sum((x.value - y.value) * (x.value - y.value)) * {len(a.EVENT_TYPES)} / count(*)) AS dist FROM ev x JOIN ev y ON x.feature = y.feature AND x.sample <> y.sample WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY ALL),
      m AS (SELECT e.sample, e.feature, d.dist, o.value, row_number() OVER (PARTITION BY e.sample, e.feature ORDER BY d.dist, d.t) AS r FROM ev e JOIN d ON d.s = e.sample JOIN ev o ON o.sample = d.t AND o.feature = e.feature WHERE e.value IS NULL AND o.value IS NOT NULL)
      SELECT sample, feature, round({value}, 5) + 0.0 AS value FROM m WHERE r <= 5 GROUP BY ALL"""


def _knn(spark: SparkSession, root: str, weights: str) -> DataFrame:
    cells = impute.knn_cells(a.event_wide(spark, root, gaps=True), "sample", a.EVENT_TYPES, 5, weights)
    return cells.select(F.col("key").alias("sample"), "feature", a.rounded("value", 5).alias("value"))


@query(_knn_sql("avg(value)"))
def impute_knn_uniform(spark: SparkSession, root: str) -> DataFrame:
    return _knn(spark, root, "uniform")


@query(_knn_sql("CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0) ELSE sum(value / dist) / sum(1 / dist) END"))
def impute_knn_distance(spark: SparkSession, root: str) -> DataFrame:
    return _knn(spark, root, "distance")


@query()
def iterative_impute(spark: SparkSession, root: str) -> DataFrame:
    return impute.impute_chained(a.event_wide(spark, root, gaps=True), "sample", a.EVENT_TYPES)


@query(f"WITH {a.SPARSE_LONG}, m AS (SELECT feature, avg((value IS NULL)::INT) AS share FROM sparse_long GROUP BY ALL) SELECT sample, feature, {R.format('value')} AS value FROM sparse_long JOIN m USING (feature) WHERE share <= 0.56")
def filter_low_quality_features(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(matrix.to_long(impute.drop_sparse(a.sparse(spark, root), 0.56, exclude=["sample"]), "sample"), ["value"])


# --- expression normalisation ------------------------------------------------------------
@query(f"WITH {a.COUNTS}, {a.LENGTHS}, t AS (SELECT sample, feature, value / (length / 1000) AS r FROM counts JOIN lengths USING (feature)) SELECT sample, feature, {R.format('r / (sum(r) OVER (PARTITION BY sample) / 1e6)')} AS value FROM t")
def tpm(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.tpm(a.counts(spark, root), a.lengths(spark, root)), ["value"]).select("sample", "feature", "value")


@query(f"WITH {a.COUNTS}, {a.LENGTHS} SELECT sample, feature, {R.format('value / (length / 1000) / (sum(value) OVER (PARTITION BY sample) / 1e6)')} AS value FROM counts JOIN lengths USING (feature)")
def fpkm(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.fpkm(a.counts(spark, root), a.lengths(spark, root)), ["value"]).select("sample", "feature", "value")


_FACTORS = f"{a.COUNTS}, g AS (SELECT feature, exp(avg(ln(1 + greatest(value, 0)))) AS g FROM counts GROUP BY ALL), f AS (SELECT sample, median(greatest(value, 0) / g) FILTER (value > 0) AS size_factor FROM counts JOIN g USING (feature) GROUP BY ALL)"


@query(f"WITH {_FACTORS} SELECT sample, {R.format('coalesce(size_factor, 1)')} AS size_factor FROM f")
def deseq2_size_factors(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.size_factors(a.counts(spark, root)), ["size_factor"])


@query(f"WITH {_FACTORS} SELECT sample, feature, {R.format('greatest(value, 0) / coalesce(size_factor, 1)')} AS value FROM counts JOIN f USING (sample)")
def deseq2_normalize(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.by_size_factor(a.counts(spark, root)), ["value"]).select("sample", "feature", "value")


@query(f"""WITH {a.COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value) AS rn, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS ar FROM counts),
    m AS (SELECT rn, avg(value) AS mean, count(*) AS n FROM r GROUP BY ALL) SELECT sample, feature, {R.format('CASE WHEN n = (SELECT count(DISTINCT sample) FROM counts) THEN mean END')} AS value FROM r JOIN m ON m.rn = floor(r.ar)""")
def quantile_normalize(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.quantile_normalize(a.counts(spark, root)), ["value"]).select("sample", "feature", "value")


_TMM = f"""{a.COUNTS}, t AS (SELECT sample, sum(value) FILTER (value > 0) AS total, sum(value) AS whole, quantile_cont(value, 0.75) FILTER (value > 0) AS uq FROM counts GROUP BY sample),
  ref AS (SELECT sample, total FROM t ORDER BY abs(uq / total - (SELECT avg(uq / total) FROM t)), sample LIMIT 1),
  x AS (SELECT c.sample, c.value AS v, t.total AS n, q.value AS rv, ref.total AS rn FROM counts c JOIN t USING (sample), ref JOIN counts q ON q.sample = ref.sample WHERE q.feature = c.feature AND c.value > 0 AND q.value > 0),
  y AS (SELECT sample, log2(v / n / (rv / rn)) AS m, 0.5 * log2(v / n * (rv / rn)) AS a, 1 / ((n - v) / n / v + (rn - rv) / rn / rv) AS w FROM x),
  k AS (SELECT *, percent_rank() OVER (PARTITION BY sample ORDER BY m) AS pm, percent_rank() OVER (PARTITION BY sample ORDER BY a) AS pa FROM y),
  e AS (SELECT t.sample, t.whole, coalesce(lf, 0) AS lf FROM t LEFT JOIN (SELECT sample, sum(w * m) / sum(w) AS lf FROM k WHERE pm BETWEEN 0.3 AND 0.7 AND pa BETWEEN 0.05 AND 0.95 GROUP BY sample) USING (sample)),
  f AS (SELECT sample, whole, pow(2, lf - (SELECT avg(lf) FROM e)) AS factor FROM e)"""


@query(f"WITH {_TMM} SELECT sample, {R.format('factor')} AS factor FROM f")
def tmm_factors(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.trimmed_mean_factors(a.counts(spark, root)), ["factor"])


@query(f"WITH {_TMM} SELECT sample, feature, {R.format('value * 1e6 / (whole * factor)')} AS value FROM counts JOIN f USING (sample)")
def tmm_normalize(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(normalize.by_trimmed_mean(a.counts(spark, root)), ["value"])


# --- scaling -----------------------------------------------------------------------------
def _scaled(name: str, method, sql: str, agg: str) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return a.tidy(method(a.embedded(spark, root).select("sample", "feature", "value")), ["value"]).select("sample", "feature", "value")

    run.__name__ = name
    query(f"WITH {a.EMB}, s AS (SELECT feature, {agg} FROM emb GROUP BY ALL) SELECT sample, feature, {R.format(sql)} AS value FROM emb JOIN s USING (feature)")(run)


_NZ = "CASE WHEN coalesce({0}, 0) = 0 THEN 1 ELSE {0} END"
_scaled("scale_standard", normalize.standard, f"(value - m) / ({_NZ.format('s')})", "avg(value) AS m, stddev_pop(value) AS s")
_scaled("scale_minmax", normalize.minmax, f"(value - lo) / ({_NZ.format('(hi - lo)')})", "min(value) AS lo, max(value) AS hi")
_scaled("scale_range", normalize.value_range, f"(value - lo) / ({_NZ.format('(hi - lo)')})", "min(value) AS lo, max(value) AS hi")
_scaled("scale_robust", normalize.robust, f"(value - m) / ({_NZ.format('(q3 - q1)')})", "quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3")
_scaled("center_median", normalize.center_median, "value - m", "quantile_cont(value, 0.5) AS m")
_scaled("scale_pareto", normalize.pareto, f"(value - m) / ({_NZ.format('sqrt(s)')})", "avg(value) AS m, stddev_samp(value) AS s")
_scaled("log2_offset", normalize.log_transform, "log2(greatest(value, 0) + 1)", "1 AS x")
_scaled("log10_offset", lambda long: normalize.log_transform(long, 10, 0.5), "log10(greatest(value, 0) + 0.5)", "1 AS x")
_scaled("log2_zscore", normalize.log2_zscore, "CASE WHEN s > 0 THEN (log2(value + 1) - m) / s ELSE log2(value + 1) END", "avg(log2(value + 1)) AS m, stddev_samp(log2(value + 1)) AS s")


@query(f"""WITH {a.EMB}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM emb WHERE sample % 5 <> 0 GROUP BY ALL)
    SELECT sample, CASE WHEN sample % 5 = 0 THEN 'test' ELSE 'train' END AS split, feature, {R.format(f"(value - m) / ({_NZ.format('s')})")} AS value FROM emb JOIN s USING (feature)""")
def scale_train_test(spark: SparkSession, root: str) -> DataFrame:
    long = a.embedded(spark, root).select("sample", F.when(F.col("sample") % 5 == 0, "test").otherwise("train").alias("split"), "feature", "value")
    return a.tidy(scale_by_train(long), ["value"]).select("sample", "split", "feature", "value")
