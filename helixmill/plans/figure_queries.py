"""The data behind the usual figures of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill import reports
from helixmill.operators import align, fuse, learn, quality, reduce
from helixmill.plans import adapters as a
from helixmill.session import durable, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
R = "round({0}, 6) + 0.0"
COLS = [f"n{i}" for i in a.LINES]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def band(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return F.when(value < low, names[0]).when(value < high, names[1]).otherwise(names[2])


@query(f"WITH {a.SPARSE_LONG}, m AS (SELECT feature, avg((value IS NULL)::INT) * 100 AS p FROM sparse_long GROUP BY ALL) SELECT feature AS column_name, {R.format('p')} AS missing_percent, CASE WHEN p < 10 THEN 'good' WHEN p < 20 THEN 'fair' ELSE 'poor' END AS band FROM m")
def figure_missing_bands(spark: SparkSession, root: str) -> DataFrame:
    report = quality.missing_report(a.sparse(spark, root), COLS)
    return a.tidy(report.select("column_name", "missing_percent", band(F.col("missing_percent"), 10, 20, ("good", "fair", "poor")).alias("band")), ["missing_percent"])


_SKEWED = f"{a.EMB}, d AS (SELECT feature, value - avg(value) OVER (PARTITION BY feature) AS d FROM emb), s AS (SELECT feature, avg(d * d * d) / pow(avg(d * d), 1.5) AS s FROM d GROUP BY ALL)"


@query(f"WITH {_SKEWED} SELECT feature, round(s, 4) + 0.0 AS skewness, CASE WHEN abs(s) < 1 THEN 'even' WHEN abs(s) < 2 THEN 'skewed' ELSE 'very skewed' END AS band FROM s")
def figure_skew_bands(spark: SparkSession, root: str) -> DataFrame:
    d = quality.distributions(a.embedded(spark, root))
    return a.tidy(d.select("feature", "skewness", band(F.abs("skewness"), 1, 2, ("even", "skewed", "very skewed")).alias("band")), ["skewness"], 4)


@query(f"WITH {a.EMB}, p AS (SELECT x.feature AS feature_a, y.feature AS feature_b, corr(x.value, y.value) AS r FROM emb x JOIN emb y ON x.sample = y.sample AND x.feature < y.feature GROUP BY ALL) SELECT feature_a, feature_b, round(r, 5) + 0.0 AS r FROM p ORDER BY abs(p.r) DESC, feature_a, feature_b LIMIT 20")
def figure_top_correlations(spark: SparkSession, root: str) -> DataFrame:
    pairs = quality.correlations(a.embedded(spark, root))
    return a.tidy(pairs.orderBy(F.desc(F.abs("r")), "feature_a", "feature_b").limit(20).select("feature_a", "feature_b", "r"), ["r"], 5)


@query()
def figure_components(spark: SparkSession, root: str) -> DataFrame:
    """The density of the first two components in 30 by 30 bins."""
    scores = reduce.pca(a.embedded_wide(spark, root), "sample", [f"d{i:02d}" for i in range(a.DIMS)], 4, scale=True).scores
    return quality.histogram_2d(scores, "PC1", "PC2")


@query("SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS frame, count(*) OVER (PARTITION BY date_trunc('day', ts)) AS n FROM events")
def figure_frames(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {a.SPARSE}, g AS (SELECT (1 - ({' + '.join(f'({c} IS NULL)::INT' for c in COLS)}) / 7.0) * 100 AS c FROM sparse) SELECT least(floor((c - lo) / ((hi - lo) / 20)) + 1, 20)::BIGINT AS bin, count(*) AS n FROM g, (SELECT min(c) AS lo, max(c) AS hi FROM g) GROUP BY ALL")
def figure_completeness_histogram(spark: SparkSession, root: str) -> DataFrame:
    return quality.histogram(quality.completeness(a.sparse(spark, root), "sample", COLS), "completeness_percent", 20)


_IQR = f"{a.EMB}, s AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM emb GROUP BY ALL), bad AS (SELECT DISTINCT sample FROM emb JOIN s USING (feature) WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5)"


@query(f"WITH {_IQR} SELECT least(floor((sample - lo) / ((hi - lo) / 20)) + 1, 20)::BIGINT AS bin, count(*) AS n FROM bad, (SELECT min(sample) AS lo, max(sample) AS hi FROM bad) GROUP BY ALL")
def figure_outlier_positions(spark: SparkSession, root: str) -> DataFrame:
    return quality.histogram(durable(quality.outliers(a.embedded(spark, root).select("sample", "feature", "value"))), "sample", 20)


_MOD = """m AS (SELECT 'customer' AS modality, c_custkey AS id FROM customer UNION ALL SELECT DISTINCT 'orders', o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT 'events', user_id FROM events), common AS (SELECT id FROM m GROUP BY ALL HAVING count(*) = 3)"""


@query(f"WITH {_MOD}, s AS (SELECT modality, count(c.id) * 100.0 / count(*) AS p FROM m LEFT JOIN common c USING (id) GROUP BY ALL) SELECT modality, {R.format('p')} AS matched_percent, CASE WHEN p < 50 THEN 'poor' WHEN p < 80 THEN 'fair' ELSE 'good' END AS band FROM s")
def figure_alignment_bands(spark: SparkSession, root: str) -> DataFrame:
    tables = {
        "customer": table(spark, root, "customer").select(F.col("c_custkey").alias("id")), "events": table(spark, root, "events").select(F.col("user_id").alias("id")),
        "orders": table(spark, root, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")),
    }
    stats = align.alignment_stats(tables, "id").select("modality", "matched_percent")
    return a.tidy(reports.bands(stats, "matched_percent", 50, 80), ["matched_percent"])


@query()
def figure_cumulative_variance(spark: SparkSession, root: str) -> DataFrame:
    found = reduce.pca(a.embedded_wide(spark, root), "sample", [f"d{i:02d}" for i in range(a.DIMS)], 20, scale=True).ratios
    rows = spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(found)], "component int, ratio double")
    # as many rows as components were asked for
    running = Window.partitionBy(F.lit(1)).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative", F.sum("ratio").over(running))


@query()
def figure_importances(spark: SparkSession, root: str) -> DataFrame:
    """The 20 most important features of a forest."""
    columns = [f"d{i:02d}" for i in range(a.DIMS)]
    wide = a.embedded_wide(spark, root).withColumn("split", learn.split_column(F.col("sample")))
    return spark.createDataFrame(learn.evaluate(wide, columns, "label")[1], "feature string, importance double")


_EVW = ", ".join(f"max(value) FILTER (feature = '{t}') AS {t}" for t in a.EVENT_TYPES)
_SHAPES = f"""{a.SPARSE}, {a.EVENTS}, w AS (SELECT sample, {_EVW} FROM ev GROUP BY ALL),
  s AS (SELECT 'events' AS modality, count(*) AS n_rows, 6 AS n_columns, sum({" + ".join(f"({t} IS NULL)::INT" for t in a.EVENT_TYPES)}) * 100.0 / (count(*) * 5) AS p FROM w
    UNION ALL SELECT 'lines', count(*), 8, sum({" + ".join(f"({c} IS NULL)::INT" for c in COLS)}) * 100.0 / (count(*) * 7) FROM sparse)"""


@query(f"WITH {_SHAPES} SELECT modality, n_rows, n_columns, {R.format('p')} AS missing_percent, CASE WHEN p < 10 THEN 'good' WHEN p < 20 THEN 'fair' ELSE 'poor' END AS band, 0::BIGINT AS duplicate_rows, 100.0 AS share_of_good_or_fair FROM s WHERE p < 20 UNION ALL SELECT modality, n_rows, n_columns, {R.format('p')}, 'poor', 0, 0.0 FROM s WHERE p >= 20")
def figure_quality_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per modality its shape, missing cells with their band, duplicates, and whether it passes."""
    parts = []
    for name, wide in (("events", a.event_wide(spark, root)), ("lines", a.sparse(spark, root))):
        columns = [c for c in wide.columns if c != "sample"]
        parts.append(quality.basic_metrics(wide).withColumn("_one", F.lit(1)).join(quality.missing_summary(wide, columns).select("missing_percent", F.lit(1).alias("_one")), "_one").select(F.lit(name).alias("modality"), "n_rows", "n_columns", "missing_percent", "duplicate_rows"))
    out = parts[0].unionByName(parts[1]).withColumn("band", band(F.col("missing_percent"), 10, 20, ("good", "fair", "poor")))
    return a.tidy(out.withColumn("share_of_good_or_fair", F.when(F.col("band") == "poor", 0.0).otherwise(100.0)), ["missing_percent"])


@query(f"WITH {_SHAPES} SELECT count(*) AS n_modalities, count(*) FILTER (p > 50) AS n_failed, count(*) FILTER (p > 20 AND p <= 50) AS n_warnings FROM s")
def figure_report_layout(spark: SparkSession, root: str) -> DataFrame:
    """Modalities of a report and how many of them fail or warn by their missing cells."""
    rows = figure_quality_summary(spark, root)
    p = F.col("missing_percent")
    return rows.agg(F.count(F.lit(1)).alias("n_modalities"), F.count_if(p > 50).alias("n_failed"), F.count_if((p > 20) & (p <= 50)).alias("n_warnings"))


def _modalities(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    return {"events": a.event_wide(spark, root), "orders": orders}


_COMMON = "k AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id AS id FROM events) JOIN (SELECT DISTINCT o_custkey AS id FROM orders) USING (id))"


@query(f"WITH {_COMMON} SELECT method, n AS n_samples, f AS n_features FROM k, (VALUES ('early', 7), ('late_events', 5), ('late_orders', 2), ('intermediate', 5)) v(method, f)")
def figure_integration_methods(spark: SparkSession, root: str) -> DataFrame:
    """(method, n_samples, n_features) of the results of every method of integration."""
    done = fuse.integrate(_modalities(spark, root), "sample", ("early", "late"))
    done |= {"intermediate": fuse.intermediate(_modalities(spark, root), "sample", components=3)}
    late = done.pop("late")
    done |= {f"late_{n}": late[n] for n in ("events", "orders")}
    rows = [t.agg(F.count(F.lit(1)).alias("n_samples")).select(F.lit(m).alias("method"), "n_samples", F.lit(len(t.columns) - 1).alias("n_features")) for m, t in done.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH {_COMMON} SELECT n AS n_matched, 3 AS n_methods, CASE WHEN n > 100 THEN 'Good' ELSE 'Fair' END AS rating, n > 0 AS aligned, true AS integrated FROM k")
def figure_integration_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row: matched samples, methods with a result, the rating (more than 100 samples and two methods or more), and which steps are done."""
    methods = figure_integration_methods(spark, root).withColumn("method", F.regexp_replace("method", "_.*", ""))
    one = methods.agg(F.min("n_samples").alias("n_matched"), F.countDistinct("method").cast("int").alias("n_methods"))
    good = (F.col("n_matched") > 100) & (F.col("n_methods") >= 2)
    return one.select("n_matched", "n_methods", F.when(good, "Good").otherwise("Fair").alias("rating"), (F.col("n_matched") > 0).alias("aligned"), (F.col("n_methods") > 0).alias("integrated"))


@query()
def figure_component_ranges(spark: SparkSession, root: str) -> DataFrame:
    """(component, range): largest less smallest score of the first four components."""
    scores = reduce.pca(a.embedded_wide(spark, root), "sample", [f"d{i:02d}" for i in range(a.DIMS)], 4, scale=True).scores
    names = [c for c in scores.columns if c != "sample"]
    return scores.agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).unpivot([], names, "component", "range")
