"""Queries over feature selection, splits, dimension reduction and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import learn, reduce
from helixmill.plans import adapters as a
from helixmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COLS = [f"d{i:02d}" for i in range(a.DIMS)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_F = f"""{a.EMB}, c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM emb GROUP BY ALL), t AS (SELECT feature, avg(value) AS gm, count(*) AS nn FROM emb GROUP BY ALL),
  f AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ss) / (any_value(nn) - count(*))) AS f FROM c JOIN t USING (feature) GROUP BY ALL)"""


@query(f"WITH {_F} SELECT feature, round(f, 5) + 0.0 AS f FROM f")
def anova_f(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(learn.anova_f(a.embedded(spark, root), "label"), ["f"], 5)


@query(f"WITH {_F} SELECT feature, round(f, 5) + 0.0 AS f FROM f ORDER BY f.f DESC, feature LIMIT 10")
def anova_f_topk(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(learn.top_features(learn.anova_f(a.embedded(spark, root), "label"), "f", 10), ["f"], 5)


_CUTS = ", ".join(f"quantile_cont(value, {i / 10}) AS q{i}" for i in range(1, 10))
_BIN = " + ".join(f"(value > q{i})::INT" for i in range(1, 10))
_MI = f"""{a.EMB}, q AS (SELECT feature, {_CUTS} FROM emb GROUP BY ALL), b AS (SELECT feature, {_BIN} AS b, label, count(*)::DOUBLE AS n FROM emb JOIN q USING (feature) GROUP BY ALL),
  w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl FROM b), mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * nl))) AS mi FROM w GROUP BY ALL)"""


@query(f"WITH {_MI} SELECT feature, round(mi, 6) + 0.0 AS mi FROM mi ORDER BY mi.mi DESC, feature LIMIT 10")
def mi_binned_topk(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(learn.top_features(learn.binned_information(a.embedded(spark, root), "label"), "mi", 10), ["mi"])


@query()
def train_test_split(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("sample"), "label", learn.split_column(F.col("vec_id")).alias("split"))


@query()
def stratified_split(spark: SparkSession, root: str) -> DataFrame:
    return learn.stratified_split(table(spark, root, "embeddings").select(F.col("vec_id").alias("sample"), "label"), "sample", "label")


@query()
def pca_scores(spark: SparkSession, root: str) -> DataFrame:
    return reduce.pca(a.embedded_wide(spark, root), "sample", COLS, 10, scale=True).scores


@query()
def pca_variance(spark: SparkSession, root: str) -> DataFrame:
    found = reduce.pca(a.embedded_wide(spark, root), "sample", COLS, 10, scale=True).ratios
    rows, total = [], 0.0
    for k, x in enumerate(found):
        total += float(x)
        rows.append((k + 1, float(x), total))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


@query()
def pca_top_loadings(spark: SparkSession, root: str) -> DataFrame:
    wide = a.embedded_wide(spark, root).drop("label")
    views = {"low": wide.select("sample", *COLS[:32]), "high": wide.select("sample", *COLS[32:])}
    found = reduce.multi_view_pca(views, "sample", 5)
    return reduce.top_loadings(reduce.loading_rows(spark, found, list(views)), 5)


@query()
def pls_scores(spark: SparkSession, root: str) -> DataFrame:
    return reduce.pls(a.embedded_wide(spark, root), "sample", COLS, "label", 3)[0].scores


@query()
def ica_scores(spark: SparkSession, root: str) -> DataFrame:
    return reduce.ica(a.embedded_wide(spark, root), "sample", COLS, 4).scores


@query()
def nmf_scores(spark: SparkSession, root: str) -> DataFrame:
    return reduce.nmf(a.embedded_wide(spark, root), "sample", COLS, 4).scores


@query()
def isolation_forest(spark: SparkSession, root: str) -> DataFrame:
    return learn.isolation_outliers(learn.isolation_scores(a.embedded_wide(spark, root), "sample", COLS))


@query()
def rfe_features(spark: SparkSession, root: str) -> DataFrame:
    rows = learn.eliminate(a.embedded_wide(spark, root), COLS, "label", 8)
    return spark.createDataFrame(rows, "feature string, importance double")


def _judged(spark: SparkSession, root: str, model: str) -> DataFrame:
    wide = a.embedded_wide(spark, root).withColumn("split", learn.split_column(F.col("sample")))
    return learn.confusion(learn.evaluate(wide, COLS, "label", model)[0])


@query()
def rf_confusion(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root, "random_forest")


@query()
def rf_class_report(spark: SparkSession, root: str) -> DataFrame:
    return learn.class_report(_judged(spark, root, "random_forest"))


@query()
def logistic_confusion(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root, "logistic")


@query()
def svm_confusion(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root, "svm")


@query()
def model_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """(model, split, n, accuracy) of every kind of model."""
    parts = [learn.accuracy(_judged(spark, root, m)).select(F.lit(m).alias("model"), "*") for m in ("random_forest", "logistic", "svm")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
