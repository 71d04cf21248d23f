"""Quality control: missing values, distributions, correlations, batches, outliers, verdicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.errors import QualityControlError
from helixmill.functions import special
from helixmill.operators.matrix import by_feature, feature_quantiles, nonzero, numeric_columns, to_long, value_frequencies
from helixmill.operators.value_counts import value_ranks
from helixmill.session import durable

def _v() -> Column:
    return F.col("value")


def row_gaps(columns: Sequence[str]) -> Column:
    """How many of the columns are NULL in a row."""
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in columns], F.lit(0))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_missing, missing_percent) of columns that miss values."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = one.unpivot(["n"], list(columns), "column_name", "n_missing")
    return long.filter("n_missing > 0").select("column_name", "n_missing", (F.col("n_missing") * 100.0 / F.col("n")).alias("missing_percent"))


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: cells, missing cells, rows with gaps, complete rows and their percentages."""
    gaps = df.select(row_gaps(columns).alias("g"))
    n, cells = F.count(F.lit(1)), F.count(F.lit(1)) * len(columns)
    return gaps.agg(
        n.alias("n_rows"), cells.alias("n_cells"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_missing"), F.try_divide(F.sum("g") * 100.0, cells).alias("missing_percent"),
        F.count_if(F.col("g") > 0).alias("rows_with_missing"), F.count_if(F.col("g") == 0).alias("complete_rows"), F.try_divide(F.count_if(F.col("g") == 0) * 100.0, n).alias("complete_percent"),
    )


def missing_patterns(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` most frequent numbers of missing values in a row."""
    return df.select(row_gaps(columns).alias("n_missing")).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "n_missing").limit(top)


def completeness(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.select(key, ((1 - row_gaps(columns) / F.lit(float(len(columns)))) * 100).alias("completeness_percent"))


def basic_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, number and text columns, and rows that repeat an earlier one."""
    same = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    numbers = len(numeric_columns(df))
    return same.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(numbers).alias("numeric_columns"), F.lit(len(df.columns) - numbers).alias("text_columns"), "duplicate_rows"
    )


def duplicated_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def describe(long: DataFrame) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles per feature."""
    quarts = feature_quantiles(long, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return by_feature(long).join(quarts, "feature", "left").select("feature", "n", "mean", F.col("sd_samp").alias("std"), F.col("low").alias("min"), "q25", "q50", "q75", F.col("high").alias("max"))


def top_values(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` most frequent values of each text column, equals in the order of the value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("p")
    counts = df.select(pairs).filter("p.v IS NOT NULL").groupBy(F.col("p.c").alias("column_name"), F.col("p.v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def distributions(long: DataFrame, least: int = 10) -> DataFrame:
    """Mean, median, sample deviation, skewness, excess kurtosis and extremes of features with enough values."""
    stats = by_feature(long, {"skewness": F.skewness(_v()), "kurtosis": F.kurtosis(_v())})
    return stats.filter(F.col("n") >= least).join(feature_quantiles(long, {"median": 0.5}), "feature").select(
        "feature", "n", "mean", "median", F.col("sd_samp").alias("std"), "skewness", "kurtosis", F.col("low").alias("min"), F.col("high").alias("max")
    )


def overall_distribution(long: DataFrame) -> DataFrame:
    """One row over all cells; the deviation is that of the population."""
    return long.agg(F.count(_v()).alias("n"), F.avg(_v()).alias("mean"), F.stddev_pop(_v()).alias("std"), F.skewness(_v()).alias("skewness"), F.kurtosis(_v()).alias("kurtosis"), F.min(_v()).alias("min"), F.max(_v()).alias("max"))


#: Features whose pairs one pass adds up in a task: six square tables of numbers.
PAIR_BLOCK = 500


def correlations(long: DataFrame, key: str = "sample", block: int = PAIR_BLOCK) -> DataFrame:
    """(feature_a, feature_b, r, n) of every pair of features, over the rows that have both.

    A task adds up the products of its rows as matrices, of ``block`` by ``block`` features at a time, and hands
    on one row per pair; rows are never multiplied by pairs. NULL where a feature does not vary.
    """
    stats = by_feature(long).filter("n > 0").select("feature", "mean").orderBy("feature").collect()
    names, means = [r["feature"] for r in stats], [r["mean"] for r in stats]
    schema = "a int, b int, n double, x double, y double, xx double, yy double, xy double"
    spark = long.sparkSession
    numbers = spark.createDataFrame(list(zip(names, range(len(names)), means)), "feature string, i int, m double")
    centred = long.filter(_v().isNotNull()).join(numbers, "feature").select(key, "i", (_v() - F.col("m")).alias("v"))
    rows = centred.groupBy(key).agg(F.collect_list(F.struct("i", "v")).alias("x"))
    starts = list(range(0, len(names), block))
    rows = durable(rows) if len(starts) > 1 else rows
    parts = [rows.select("x").mapInPandas(_pair_sums(s, t, block, len(names)), schema) for s in starts for t in starts if s <= t]
    total = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    t = total.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    sx, sy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    first, second = numbers.selectExpr("i AS a", "feature AS feature_a", "m AS ma"), numbers.selectExpr("i AS b", "feature AS feature_b", "m AS mb")
    # what is left by rounding around a large mean is no variance
    varies = (sx > F.col("n") * F.col("ma") * F.col("ma") * 1e-24) & (sy > F.col("n") * F.col("mb") * F.col("mb") * 1e-24)
    r = F.when(varies, F.greatest(F.least((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(sx * sy), F.lit(1.0)), F.lit(-1.0)))
    return t.join(first, "a").join(second, "b").select("feature_a", "feature_b", r.alias("r"), F.col("n").cast("long").alias("n"))


def _pair_sums(s: int, t: int, block: int, n: int):
    """Sums over rows that have both features, for features from ``s`` on by features from ``t`` on."""
    left, right = np.arange(s, min(s + block, n)), np.arange(t, min(t + block, n))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, len(left), len(right)))
        for pdf in batches:
            at = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["x"]])
            i = np.array([e["i"] for x in pdf["x"] for e in x], dtype=np.int64)
            v = np.array([e["v"] for x in pdf["x"] for e in x], dtype=float)
            tables = []
            for low, size in ((s, len(left)), (t, len(right))):
                mine = (i >= low) & (i < low + size)
                x, have = np.zeros((len(pdf), size)), np.zeros((len(pdf), size))
                x[at[mine], i[mine] - low], have[at[mine], i[mine] - low] = v[mine], 1.0
                tables.append((x, have))
            (x, hx), (y, hy) = tables
            sums += np.stack([hx.T @ hy, x.T @ hy, hx.T @ y, (x * x).T @ hy, hx.T @ (y * y), x.T @ y])
        a, b = np.nonzero((left[:, None] < right[None, :]) & (sums[0] > 0))
        yield pd.DataFrame({"a": left[a].astype("int32"), "b": right[b].astype("int32"), **{c: sums[k, a, b] for k, c in enumerate(("n", "x", "y", "xx", "yy", "xy"))}})

    return work


def high_correlations(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.filter(F.abs("r") > threshold)


def correlation_summary(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.agg(F.count_if(F.abs("r") > threshold).alias("n_high"), F.max(F.abs("r")).alias("max_abs_r"), F.avg(F.abs("r")).alias("mean_abs_r"))


def batch_stats(long: DataFrame, batch: str) -> DataFrame:
    """Mean and sample deviation per batch and feature, for batches of more than one row."""
    return long.filter(_v().isNotNull()).groupBy(batch, "feature").agg(F.avg(_v()).alias("mean"), F.stddev_samp(_v()).alias("std"), F.count(_v()).alias("n")).filter("n > 1")


def kruskal(long: DataFrame, group: str) -> DataFrame:
    """(feature, n, groups, h, p_value) of the Kruskal-Wallis test, corrected for ties."""
    known = long.filter(_v().isNotNull() & F.col(group).isNotNull())
    # values are counted by group first, so a value that many rows share is one row per group from here on
    counts = known.groupBy("feature", "value", group).agg(F.count(F.lit(1)).alias("k"))
    ranks = value_ranks(counts.groupBy("feature", "value").agg(F.sum("k").alias("cnt")), ["feature"])
    ranks = ranks.withColumn("rank", F.col("before") + (F.col("cnt") + 1) / 2)
    ties = ranks.groupBy("feature").agg(F.sum(F.col("cnt").cast("double") * F.col("cnt") * F.col("cnt") - F.col("cnt")).alias("ties"))
    sums = counts.join(ranks.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", group).agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("n"))
    per = sums.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / nonzero(1 - F.col("ties") / (n * n * n - n))
    return per.join(ties, "feature").filter("n > 1").select("feature", "n", "groups", h.alias("h")).withColumn("p_value", _p_value("h", "groups"))


def _p_value(h: str, groups: str) -> Column:
    @F.pandas_udf("double")
    def p(h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([special.chi2_sf(float(a), float(b) - 1) if b > 1 else None for a, b in zip(h, g)], dtype="float64")

    return p(F.col(h), F.col(groups))


def batch_effect(tests: DataFrame, level: float = 0.05, share: float = 0.1) -> DataFrame:
    """One row: how many features differ between batches, and whether that is more than ``share`` of them."""
    hits = F.count_if(F.col("p_value") < level)
    return tests.agg(F.count(F.lit(1)).alias("n_features"), hits.alias("n_significant"), (hits > F.count(F.lit(1)) * share).alias("batch_effect"))


def two_groups(long: DataFrame, group: str, a, b) -> DataFrame:
    """Welch's t and its two-sided p per feature for the groups ``a`` and ``b``."""
    side = lambda g: F.when(F.col(group) == g, _v())
    s = long.groupBy("feature").agg(*[f(side(g)).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    df = (ea + eb) * (ea + eb) / (ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))

    @F.pandas_udf("double")
    def p(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([special.t_sf2(float(x), float(y)) if pd.notna(x) and pd.notna(y) else None for x, y in zip(t, d)], dtype="float64")

    out = s.filter("na > 1 AND nb > 1").select("feature", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("t"), df.alias("df"))
    return out.withColumn("p_value", p("t", "df"))


def mann_whitney(long: DataFrame, group: str, a, b) -> DataFrame:
    """U of group ``a`` against ``b`` and a normal-approximation p with tie correction."""
    known = long.filter(_v().isNotNull() & F.col(group).isin(a, b))
    first = F.col(group) == a
    counts = known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(first).alias("ka"))
    ranks = value_ranks(counts, ["feature"]).withColumn("rank", F.col("before") + (F.col("cnt") + 1) / 2)
    ties = ranks.groupBy("feature").agg(F.sum(F.col("cnt").cast("double") * F.col("cnt") * F.col("cnt") - F.col("cnt")).alias("ties"))
    sums = ranks.groupBy("feature").agg(F.sum(F.col("rank") * F.col("ka")).alias("r"), F.sum("ka").cast("double").alias("na"), F.sum(F.col("cnt") - F.col("ka")).cast("double").alias("nb"))
    n = F.col("na") + F.col("nb")
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * special.normal_sf(abs(x))) for x in z], dtype="float64")

    z = F.greatest(F.abs(u - F.col("na") * F.col("nb") / 2) - 0.5, F.lit(0.0)) / sd
    return sums.join(ties, "feature").filter("na > 0 AND nb > 0").select("feature", u.alias("u"), z.alias("z")).withColumn("p_value", p("z"))


def normality(long: DataFrame, most: int = 5000) -> DataFrame:
    """(feature, n, w, p_value, test) for every feature of 3 values or more.

    Up to ``most`` values w is Shapiro and Wilk's, whose approximation ends at 5,000; above, it is Anderson
    and Darling's from the counts of all values.
    """
    known = long.filter(_v().isNotNull()).select("feature", "value")
    counts = known.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    of = lambda kind: known.join(counts.filter(kind).select("feature"), "feature")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = special.shapiro_wilk(pdf["value"].tolist())
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "n": [len(pdf)], "w": [w], "p_value": [p]})

    small = of(F.col("n") <= most).select("feature", "value").groupBy("feature").applyInPandas(test, "feature string, n long, w double, p_value double")
    return small.withColumn("test", F.lit("shapiro_wilk")).unionByName(anderson_darling(of(F.col("n") > most)).withColumn("test", F.lit("anderson_darling")))


def anderson_darling(long: DataFrame) -> DataFrame:
    """(feature, n, w, p_value): the size-adjusted A squared and its p; a feature of one value has w 0 and p 1."""
    known = long.filter(_v().isNotNull())
    moments = by_feature(known).select("feature", "n", "mean", "sd_samp", "low", "high")
    ranks = value_ranks(value_frequencies(known, ["feature"]), ["feature"])

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series([special.log_normal_sf(x) for x in z], dtype="float64")

    @F.pandas_udf("double")
    def p(a: pd.Series) -> pd.Series:
        return pd.Series([special.anderson_darling_p(x) for x in a], dtype="float64")

    # the cnt equal values stand at the ranks before + 1 to before + cnt, whose 2 i - 1 add up to cnt (2 before + cnt)
    z = F.when(F.col("high") > F.col("low"), (_v() - F.col("mean")) / F.col("sd_samp")).otherwise(0.0)
    up = F.col("cnt") * (2.0 * F.col("before") + F.col("cnt"))
    down = 2.0 * F.col("cnt") * F.col("n") - up
    placed = ranks.join(moments, "feature").select("feature", "n", "low", "high", up.alias("up"), down.alias("down"), z.alias("z"))
    n = F.col("n")
    a = F.when(F.col("high") > F.col("low"), (-n - F.col("s") / n) * (1 + 0.75 / n + 2.25 / (n * n))).otherwise(0.0)
    sums = placed.groupBy("feature", "n", "low", "high").agg(F.sum(F.col("up") * tail(-F.col("z")) + F.col("down") * tail("z")).alias("s"))
    return sums.select("feature", "n", a.alias("w")).withColumn("p_value", F.when(F.col("w") > 0, p("w")).otherwise(1.0))


def gene_quality(long: DataFrame) -> DataFrame:
    """Per gene mean, sample deviation, coefficient of variation, and whether it is low or very variable.

    Low genes are those below the lower quartile of the gene means, variable ones above
    the 90th percentile of the coefficients.
    """
    genes = by_feature(long).select("feature", "mean", F.col("sd_samp").alias("std"), F.try_divide(F.col("sd_samp"), F.col("mean")).alias("cv"))
    low = feature_quantiles(genes.select(F.lit("mean").alias("feature"), F.col("mean").alias("value")), {"q": 0.25}).first()
    high = feature_quantiles(genes.select(F.lit("cv").alias("feature"), F.col("cv").alias("value")), {"q": 0.9}).first()
    return genes.withColumn("low", F.col("mean") < F.lit(low["q"] if low else None).cast("double")).withColumn("variable", F.coalesce(F.col("cv") > F.lit(high["q"] if high else None).cast("double"), F.lit(False)))


def library_quality(long: DataFrame, fence: float = 1.5) -> DataFrame:
    """Per sample its sum, and whether that lies outside the Tukey fences of all sums."""
    sums = long.groupBy("sample").agg(F.sum("value").alias("library_size"))
    q = feature_quantiles(sums.select(F.lit("s").alias("feature"), F.col("library_size").alias("value")), {"q1": 0.25, "q3": 0.75}).first()
    low, high = (q["q1"] - fence * (q["q3"] - q["q1"]), q["q3"] + fence * (q["q3"] - q["q1"])) if q else (None, None)
    return sums.withColumn("unusual", (F.col("library_size") < F.lit(low)) | (F.col("library_size") > F.lit(high)))


def expression_summary(genes: DataFrame, libraries: DataFrame) -> DataFrame:
    g = genes.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("low").alias("n_low"), F.try_divide(F.count_if("low") * 100.0, F.count(F.lit(1))).alias("low_percent"), F.count_if("variable").alias("n_variable"), F.avg("cv").alias("mean_cv"))
    s = libraries.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("library_size").alias("mean_library"), F.stddev_samp("library_size").alias("std_library"), F.try_divide(F.count_if("unusual") * 100.0, F.count(F.lit(1))).alias("unusual_percent"))
    one = F.lit(1).alias("_one")
    return g.select("*", one).join(s.select("*", one), "_one").drop("_one")


def verdict(metrics: DataFrame, contamination: float = 0.05) -> DataFrame:
    """PASS, WARNING or FAIL from duplicate_rows, missing_percent, outlier_percent, low_percent and unusual_percent."""
    c = F.col
    fail = (c("duplicate_rows") > 0) | (c("missing_percent") > 50) | (c("outlier_percent") > 20) | (c("low_percent") > 70) | (c("unusual_percent") > 20)
    warn = (c("missing_percent") > 20) | (c("outlier_percent") > contamination * 100) | (c("low_percent") > 50)
    return metrics.withColumn("verdict", F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS"))


def outliers(long: DataFrame, method: str = "iqr", limit: float | None = None, key: str = "sample") -> DataFrame:
    """The keys of rows with any value outside the fences of its feature."""
    if method == "iqr":
        k = 1.5 if limit is None else limit
        s = feature_quantiles(long, {"q1": 0.25, "q3": 0.75})
        width = (F.col("q3") - F.col("q1")) * k
        bad = (_v() < F.col("q1") - width) | (_v() > F.col("q3") + width)
    elif method == "zscore":
        s = by_feature(long)
        bad = F.abs(_v() - F.col("mean")) > (3.0 if limit is None else limit) * F.col("sd_pop")
    else:
        raise QualityControlError(f"unknown outlier method {method}")
    return long.join(s, "feature").filter(bad).select(key).distinct()


def remove_rows(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad, key, "left_anti")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal widths; the top edge belongs to the last bin."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    return df.filter(F.col(column).isNotNull()).groupBy(_bin(F.col(column), r["a"], r["b"], bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    r = df.agg(F.min(x).alias("xa"), F.max(x).alias("xb"), F.min(y).alias("ya"), F.max(y).alias("yb")).first()
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(_bin(F.col(x), r["xa"], r["xb"], bins).alias("bin_x"), _bin(F.col(y), r["ya"], r["yb"], bins).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def _bin(v: Column, low: float | None, high: float | None, bins: int) -> Column:
    if low is None or high == low:
        return F.lit(1).cast("long")
    return F.least(F.floor((v - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("long")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, n, balance): sizes of the classes and the ratio of the smallest to the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg((F.min("n") / F.max("n")).alias("balance")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(ends, "_one").drop("_one")


def matrix_quality(long: DataFrame) -> DataFrame:
    """Mean of means, mean of deviations, extremes and sparsity of a matrix."""
    s = by_feature(long, {"zeros": F.count_if(_v() == 0), "cells": F.count(F.lit(1))})
    return s.agg(F.avg("mean").alias("mean_of_means"), F.avg("sd_samp").alias("mean_of_std"), F.min("low").alias("min"), F.max("high").alias("max"), F.try_divide(F.sum("zeros"), F.sum("cells")).alias("sparsity"))


def density(long: DataFrame) -> DataFrame:
    """Share of cells that are not 0; a missing cell counts as not 0."""
    return long.agg(F.avg((_v().isNull() | (_v() != 0)).cast("double")).alias("density"))


def modality_report(modality: str, wide: DataFrame, key: str, contamination: float = 0.05) -> DataFrame:
    """One row of quality metrics and the verdict for a modality."""
    columns = numeric_columns(wide, [key])
    long = to_long(wide, key, columns).withColumnRenamed(key, "sample")
    n = F.lit(1).alias("_one")
    bad = outliers(long).agg(F.count(F.lit(1)).alias("n_outliers"))
    genes, libraries = gene_quality(long), library_quality(long)
    parts = [basic_metrics(wide), missing_summary(wide, columns).select("missing_percent", "complete_percent"), bad, expression_summary(genes, libraries)]
    out = parts[0].select("*", n)
    for p in parts[1:]:
        out = out.join(p.select("*", n), "_one")
    out = out.drop("_one").withColumn("outlier_percent", F.try_divide(F.col("n_outliers") * 100.0, F.col("n_rows"))).withColumn("modality", F.lit(modality))
    return verdict(out, contamination)


def report_text(rows: DataFrame) -> str:
    """A readable report of ``modality_report`` rows, one per modality."""
    lines = []
    for r in rows.orderBy("modality").collect():
        lines.append(f"{r['modality']}: {r['verdict']} ({r['n_rows']} rows, {r['n_columns']} columns, {r['missing_percent']:.1f} % missing, {r['n_outliers']} outliers, {r['duplicate_rows']} duplicates)")
    return "\n".join(lines)
