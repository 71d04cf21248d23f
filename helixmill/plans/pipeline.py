"""The end-to-end pipeline: impute, normalise, align, fuse, and its query over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.config import Config
from helixmill.errors import IntegrationError
from helixmill.operators import align, fuse, impute, learn, quality
from helixmill.operators.matrix import numeric_columns, to_long, to_wide
from helixmill.operators.normalize import normalize_wide
from helixmill.plans import adapters as a
from helixmill.session import durable, table


def preprocess(df: DataFrame, key: str, strategy: str = "median", k: int = 5, sparse: float = 1.0) -> DataFrame:
    """Drop columns that miss more than the share ``sparse``, then impute."""
    kept = df if sparse >= 1 else impute.drop_sparse(df, sparse, [key])
    return impute.impute(kept, strategy, key=key, k=k)


def normalise(df: DataFrame, key: str, method: str = "log2_scale") -> DataFrame:
    return normalize_wide(df, key, method)


def outlying(df: DataFrame, key: str, method: str, contamination: float = 0.05) -> DataFrame:
    """The keys of outlying rows by fences, by z-scores, or the share ``contamination`` by an isolation forest."""
    columns = numeric_columns(df, [key])
    if method == "isolation_forest":
        return learn.isolation_outliers(learn.isolation_scores(df, key, columns), contamination).select(key)
    return quality.outliers(to_long(df, key, columns), method, key=key)


def run(omic: DataFrame, clinical: DataFrame, key: str, imputation: str = "median", normalisation: str = "log2_scale", scale: bool | str = False, k: int = 5, sparse: float = 1.0, outliers: str = "none", contamination: float = 0.05) -> DataFrame:
    """Impute both tables, drop outlying samples, normalise the omic one, keep the common samples and join them."""
    measured = preprocess(omic, key, imputation, k, sparse)
    if outliers != "none":
        measured = quality.remove_rows(measured, outlying(measured, key, outliers, contamination), key)
    ready = {"omic": normalise(measured, key, normalisation), "clinical": preprocess(clinical, key, imputation, k, sparse)}
    aligned = align.align(ready, key)
    out = fuse.join_on(aligned, key)
    if scale:
        out = fuse.scale_columns(out, key, "standard" if scale is True else scale)
    return out


def pipeline_options(config: Config) -> dict[str, object]:
    """The options of ``run`` that a configuration stands for."""
    get = config.get
    return {
        "imputation": get("preprocessing.imputation.method"), "k": int(get("preprocessing.imputation.k")), "sparse": float(get("preprocessing.imputation.threshold_missing")),
        "normalisation": get("preprocessing.normalization.method"), "outliers": get("preprocessing.outliers.method"), "contamination": float(get("preprocessing.outliers.contamination")),
        "scale": get("integration.scaling") if get("integration.scale_features") else False,
    }


def summary(df: DataFrame, key: str) -> DataFrame:
    """One row: samples, features and the percentage of cells that are filled."""
    columns = [c for c in df.columns if c != key]
    gaps = df.select(quality.row_gaps(columns).alias("g"))
    return gaps.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(len(columns)).cast("long").alias("n_features"), (100 - F.try_divide(F.sum("g") * 100.0, F.count(F.lit(1)) * len(columns))).alias("completeness_percent"))


def run_checked(omic: DataFrame, clinical: DataFrame, key: str, **options) -> dict[str, object]:
    """The result with its status and summary; failures come back as a message."""
    try:
        out = run(omic, clinical, key, **options)
        facts = summary(out, key).first().asDict()
        if not facts["n_samples"]:
            raise IntegrationError("the tables share no sample")
        return {"status": "success", "data": out, **facts}
    except Exception as error:
        return {"status": "error", "error": str(error)}


BRAND_COLUMNS = [f"b{i:02d}" for i in range(1, 26)]


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    long = a.counts(spark, root).withColumn("i", F.regexp_extract("feature", "[0-9]+$", 0).cast("int"))
    gappy = long.select(F.col("sample").alias("s_suppkey"), F.concat(F.lit("b"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.when(F.pmod(F.col("sample") * 7 + F.col("i") * 3, F.lit(11)) != 0, F.col("value")).alias("value"))
    # statistics are fitted in several passes; the matrix is far smaller than the rows it is made of
    omic = durable(to_wide(gappy, "s_suppkey", "feature", "value", BRAND_COLUMNS))
    s, n, r = table(spark, root, "supplier"), table(spark, root, "nation"), table(spark, root, "region")
    clinical = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.when(F.pmod(F.col("s_suppkey"), F.lit(9)) != 0, F.col("r_name"))
    balance = F.when(F.pmod(F.col("s_suppkey"), F.lit(10)) != 0, F.col("s_acctbal"))
    return omic, clinical.select("s_suppkey", balance.alias("balance"), region.alias("region"))


def pipeline_flagship(spark: SparkSession, root: str) -> DataFrame:
    omic, clinical = _inputs(spark, root)
    return a.tidy(a.tidy(run(omic, clinical, "s_suppkey"), BRAND_COLUMNS, 5), ["balance"], 4)


def pipeline_summary(spark: SparkSession, root: str) -> DataFrame:
    omic, clinical = _inputs(spark, root)
    return a.tidy(summary(run(omic, clinical, "s_suppkey"), "s_suppkey"), ["completeness_percent"])


def _normalised_by(method: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        omic, clinical = _inputs(spark, root)
        return a.tidy(a.tidy(run(omic, clinical, "s_suppkey", normalisation=method), BRAND_COLUMNS, 5), ["balance"], 4)

    query.__name__ = f"pipeline_{method}"
    return query


METHODS = ("zscore", "minmax", "robust", "median_centering", "pareto_scaling", "tpm", "quantile", "tmm")
QUERIES = {f.__name__: f for f in (pipeline_flagship, pipeline_summary, *map(_normalised_by, METHODS))}

_INPUT = f"""{a.COUNTS}, w AS (SELECT sample AS s_suppkey, {", ".join(f"avg(value) FILTER (feature = 'Brand#{i}' AND (sample * 7 + {i} * 3) % 11 <> 0) AS b{i:02d}" for i in range(1, 26))} FROM counts GROUP BY ALL),
  l AS (SELECT s_suppkey, {", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in BRAND_COLUMNS)} FROM w),
  g AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS balance, CASE WHEN s_suppkey % 9 <> 0 THEN r_name END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  c AS (SELECT s_suppkey, coalesce(balance, median(balance) OVER ()) AS balance, coalesce(region, (SELECT region FROM g WHERE region IS NOT NULL GROUP BY region ORDER BY count(*) DESC, region LIMIT 1)) AS region FROM g)"""
_SQL = f"""WITH {_INPUT}, k AS (SELECT s_suppkey, {", ".join(f"log2({c} + 1) AS {c}" for c in BRAND_COLUMNS)} FROM l),
  z AS (SELECT s_suppkey, {", ".join(f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE {c} END AS {c}" for c in BRAND_COLUMNS)} FROM k)"""
ORACLE = {
    "pipeline_flagship": f"{_SQL} SELECT s_suppkey, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in BRAND_COLUMNS)}, round(balance, 4) + 0.0 AS balance, region FROM z JOIN c USING (s_suppkey)",
    "pipeline_summary": f"{_SQL} SELECT count(*) AS n_samples, 27::BIGINT AS n_features, 100.0 AS completeness_percent FROM z JOIN c USING (s_suppkey)",
}

_BY_COLUMN = {
    "zscore": "({0} - avg({0}) OVER ()) / coalesce(nullif(stddev_pop({0}) OVER (), 0), 1)",
    "minmax": "({0} - min({0}) OVER ()) / coalesce(nullif(max({0}) OVER () - min({0}) OVER (), 0), 1)",
    "robust": "({0} - median({0}) OVER ()) / coalesce(nullif(quantile_cont({0}, 0.75) OVER () - quantile_cont({0}, 0.25) OVER (), 0), 1)",
    "median_centering": "{0} - median({0}) OVER ()",
    "pareto_scaling": "({0} - avg({0}) OVER ()) / coalesce(nullif(sqrt(stddev_samp({0}) OVER ()), 0), 1)",
    "tpm": "{0} * 1e6 / (" + " + ".join(BRAND_COLUMNS) + ")",
}
_ROWS = f"""u AS (SELECT s_suppkey, feature, v FROM l UNPIVOT (v FOR feature IN ({", ".join(BRAND_COLUMNS)}))),
  r AS (SELECT *, floor(rank() OVER (PARTITION BY s_suppkey ORDER BY v) - 1 + (count(*) OVER (PARTITION BY s_suppkey, v) + 1) / 2.0) AS low, row_number() OVER (PARTITION BY s_suppkey ORDER BY v) AS no FROM u),
  m AS (SELECT no, avg(v) AS mean FROM r GROUP BY no), z AS (SELECT s_suppkey, {", ".join(f"max(mean) FILTER (feature = '{c}') AS {c}" for c in BRAND_COLUMNS)} FROM r JOIN m ON m.no = r.low GROUP BY s_suppkey)"""
# trimmed means of log ratios against the sample whose upper quartile is nearest the mean
_TRIMMED = f"""u AS (SELECT s_suppkey AS s, feature AS f, v FROM l UNPIVOT (v FOR feature IN ({", ".join(BRAND_COLUMNS)}))), t AS (SELECT s, sum(v) FILTER (v > 0) AS total, sum(v) AS whole, quantile_cont(v, 0.75) FILTER (v > 0) AS uq FROM u GROUP BY s),
  ref AS (SELECT s, total FROM t ORDER BY abs(uq / total - (SELECT avg(uq / total) FROM t)), s LIMIT 1), x AS (SELECT u.s, u.f, u.v, t.total AS n, q.v AS rv, ref.total AS rn FROM u JOIN t USING (s), ref JOIN u q ON q.s = ref.s WHERE q.f = u.f AND u.v > 0 AND q.v > 0),
  y AS (SELECT s, log2(v / n / (rv / rn)) AS m, 0.5 * log2(v / n * (rv / rn)) AS a, 1 / ((n - v) / n / v + (rn - rv) / rn / rv) AS w FROM x),
  k AS (SELECT *, percent_rank() OVER (PARTITION BY s ORDER BY m) AS pm, percent_rank() OVER (PARTITION BY s ORDER BY a) AS pa FROM y),
  e AS (SELECT t.s, t.whole, coalesce(lf, 0) AS lf FROM t LEFT JOIN (SELECT s, sum(w * m) / sum(w) AS lf FROM k WHERE pm BETWEEN 0.3 AND 0.7 AND pa BETWEEN 0.05 AND 0.95 GROUP BY s) USING (s)),
  z AS (SELECT s_suppkey, {", ".join(f"{c} * 1e6 / (whole * pow(2, lf - (SELECT avg(lf) FROM e))) AS {c}" for c in BRAND_COLUMNS)} FROM l JOIN e ON e.s = s_suppkey)"""
for _m in METHODS:
    _z = f"z AS (SELECT s_suppkey, {', '.join(f'{_BY_COLUMN[_m].format(c)} AS {c}' for c in BRAND_COLUMNS)} FROM l)" if _m in _BY_COLUMN else _ROWS if _m == "quantile" else _TRIMMED
    ORACLE[f"pipeline_{_m}"] = f"WITH {_INPUT}, {_z} SELECT s_suppkey, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in BRAND_COLUMNS)}, round(balance, 4) + 0.0 AS balance, region FROM z JOIN c USING (s_suppkey)"
