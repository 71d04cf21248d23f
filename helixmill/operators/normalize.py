"""Normalisation and scaling of long matrices; each function returns the frame with new values.

Statistics are one aggregation per feature or sample, joined back by key, so the engine
broadcasts them where they are small and shuffles where they are not.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import e

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.errors import PreprocessingError
from helixmill.functions.text import clean_number
from helixmill.operators.matrix import by_feature, feature_quantiles, nonzero, numeric_columns, to_long, to_wide, value_frequencies
from helixmill.operators.value_counts import quantiles, value_ranks

def _v() -> Column:
    return F.col("value")


def _apply(long: DataFrame, stats: DataFrame, value: Column) -> DataFrame:
    names = [c for c in stats.columns if c != "feature"]
    return long.join(stats, "feature", "left").withColumn("value", value).drop(*names)


def standard(long: DataFrame, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 divides by 1."""
    x = _v() - F.col("mean") if with_mean else _v()
    return _apply(long, by_feature(long), x / nonzero(F.col("sd_pop")) if with_std else x)


def minmax(long: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    unit = (_v() - F.col("low")) / nonzero(F.col("high") - F.col("low"))
    return _apply(long, by_feature(long), unit * (high - low) + low)


def value_range(long: DataFrame) -> DataFrame:
    return minmax(long)


def robust(long: DataFrame) -> DataFrame:
    stats = feature_quantiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return _apply(long, stats, (_v() - F.col("median")) / nonzero(F.col("q3") - F.col("q1")))


def center_median(long: DataFrame) -> DataFrame:
    return _apply(long, feature_quantiles(long, {"median": 0.5}), _v() - F.col("median"))


def pareto(long: DataFrame) -> DataFrame:
    """(x - mean) / root of the sample deviation."""
    return _apply(long, by_feature(long), (_v() - F.col("mean")) / nonzero(F.sqrt(F.col("sd_samp"))))


def log_value(value: Column, base: float = 2.0, offset: float = 1.0) -> Column:
    """Logarithm of the value, not below 0, plus an offset; NULL where that is not positive."""
    x = F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)) + offset)
    y = F.when(x > 0, x)
    return F.log2(y) if base == 2 else F.log10(y) if base == 10 else F.log(y) if base == e else F.log(y) / F.log(F.lit(float(base)))


def log_transform(long: DataFrame, base: float = 2.0, offset: float = 1.0) -> DataFrame:
    return long.withColumn("value", log_value(_v(), base, offset))


def log2_zscore(long: DataFrame) -> DataFrame:
    """log2(x + 1), then z-scores by the sample deviation; constant features stay logarithms."""
    logged = long.withColumn("value", F.when(_v() > -1, F.log2(_v() + 1)))
    return _apply(logged, by_feature(logged), F.when(F.col("sd_samp") > 0, (_v() - F.col("mean")) / F.col("sd_samp")).otherwise(_v()))


def tpm(long: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transcripts per million: value per kilobase, then per sample to a sum of a million.

    ``lengths`` is (feature, length in bases). A length or sum of 0 gives 0.
    """
    rate = long.join(lengths, "feature").withColumn("_rate", F.try_divide(_v(), F.col("length") / 1000.0))
    sums = rate.groupBy("sample").agg(F.sum("_rate").alias("_total"))
    share = F.try_divide(F.col("_rate"), F.col("_total") / 1e6)
    return rate.join(sums, "sample").withColumn("value", F.when(_v().isNotNull(), F.coalesce(share, F.lit(0.0)))).drop("_rate", "_total", "length")


def fpkm(long: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """Value per kilobase and per million of the sample's raw values; without lengths as ``tpm``."""
    if lengths is None:
        return tpm(long, long.select("feature").distinct().withColumn("length", F.lit(1000.0)))
    sums = long.groupBy("sample").agg(F.sum("value").alias("_total"))
    x = F.try_divide(F.try_divide(_v(), F.col("length") / 1000.0), F.col("_total") / 1e6)
    return long.join(lengths, "feature").join(sums, "sample").withColumn("value", F.when(_v().isNotNull(), F.coalesce(x, F.lit(0.0)))).drop("_total", "length")


def size_factors(long: DataFrame) -> DataFrame:
    """(sample, size_factor): median ratio to exp(mean(log1p)) of each feature; 1 where there is none."""
    x = F.greatest(_v(), F.lit(0.0))
    centre = long.filter("value IS NOT NULL").groupBy("feature").agg(F.exp(F.avg(F.log1p(x))).alias("_g"))
    ratios = long.filter("value IS NOT NULL").join(centre, "feature").select("sample", (x / F.col("_g")).alias("value")).filter("value > 0")
    medians = quantiles(value_frequencies(ratios, ["sample"]), ["sample"], {"size_factor": 0.5})
    return long.select("sample").distinct().join(medians, "sample", "left").select("sample", F.coalesce("size_factor", F.lit(1.0)).alias("size_factor"))


def by_size_factor(long: DataFrame) -> DataFrame:
    return long.join(size_factors(long), "sample").withColumn("value", F.greatest(_v(), F.lit(0.0)) / F.col("size_factor")).drop("size_factor")


def trimmed_mean_factors(long: DataFrame, ratio_trim: float = 0.3, level_trim: float = 0.05) -> DataFrame:
    """(sample, factor) by trimmed means of log ratios (Robinson and Oshlack 2010).

    The reference sample is the one whose upper quartile is nearest the mean upper quartile.
    """
    counts = long.filter("value > 0")
    totals = counts.groupBy("sample").agg(F.sum("value").alias("total"))
    upper = feature_quantiles(counts, {"uq": 0.75}, keys=["sample"]).join(totals, "sample").select("sample", (F.col("uq") / F.col("total")).alias("u"))
    mean = upper.agg(F.avg("u")).first()[0]
    pick = upper.orderBy(F.abs(F.col("u") - F.lit(mean)), "sample").limit(1).select("sample").first()
    if pick is None:
        return long.select("sample", F.lit(1.0).alias("factor")).distinct()
    shares = counts.join(totals, "sample").select("sample", "feature", (_v() / F.col("total")).alias("p"), "total", "value")
    ref = shares.filter(F.col("sample") == F.lit(pick[0])).select("feature", F.col("p").alias("r"), F.col("value").alias("rv"), F.col("total").alias("rt"))
    pairs = shares.join(ref, "feature").select(
        "sample", "feature", F.log2(F.col("p") / F.col("r")).alias("m"), (0.5 * F.log2(F.col("p") * F.col("r"))).alias("a"),
        (1 / ((F.col("total") - _v()) / F.col("total") / _v() + (F.col("rt") - F.col("rv")) / F.col("rt") / F.col("rv"))).alias("w"),
    )
    # one sample's features: as many rows as the matrix has features
    w = Window.partitionBy("sample")
    n = F.count(F.lit(1)).over(w)
    ranked = pairs.withColumn("rm", F.percent_rank().over(w.orderBy("m"))).withColumn("ra", F.percent_rank().over(w.orderBy("a"))).withColumn("n", n)
    kept = ranked.filter(F.col("rm").between(ratio_trim, 1 - ratio_trim) & F.col("ra").between(level_trim, 1 - level_trim))
    raw = kept.groupBy("sample").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("lf"))
    all_samples = long.select("sample").distinct().join(raw, "sample", "left").select("sample", F.coalesce("lf", F.lit(0.0)).alias("lf"))
    centre = all_samples.agg(F.avg("lf")).first()[0]
    return all_samples.select("sample", F.pow(F.lit(2.0), F.col("lf") - F.lit(centre)).alias("factor"))


def by_trimmed_mean(long: DataFrame) -> DataFrame:
    """Counts per million of the sample's sum, corrected by its trimmed-mean factor."""
    sums = long.groupBy("sample").agg(F.sum("value").alias("_total")).join(trimmed_mean_factors(long), "sample")
    return long.join(sums, "sample").withColumn("value", F.try_divide(_v() * 1e6, F.col("_total") * F.col("factor"))).drop("_total", "factor")


def quantile_normalize(long: DataFrame, column: str = "sample") -> DataFrame:
    """Give every column the same distribution: a value becomes the mean of all values of its rank.

    Tied values take the rank below their average rank; ranks that a column with missing
    values does not reach have no mean.
    """
    n_columns = long.select(column).distinct().count()
    ranks = value_ranks(value_frequencies(long, [column]), [column])
    spread = ranks.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("cnt"))))
    means = spread.groupBy("rank").agg(F.when(F.count(F.lit(1)) == n_columns, F.avg("value")).alias("mean"))
    target = ranks.select(column, "value", F.floor(F.col("before") + (F.col("cnt") + 1) / 2).alias("rank")).join(means, "rank", "left").select(column, "value", "mean")
    return long.join(target, [column, "value"], "left").withColumn("value", F.col("mean")).drop("mean")


#: Methods by kind of measurement; the first is the default.
METHODS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "gene_expression": {"tpm": tpm, "fpkm": fpkm, "deseq2_size_factors": by_size_factor, "tmm": by_trimmed_mean, "quantile": quantile_normalize, "standard": standard},
    "proteomics": {"median_centering": center_median, "quantile": quantile_normalize, "standard": standard, "robust": robust},
    "metabolomics": {"pareto_scaling": pareto, "auto_scaling": standard, "range_scaling": value_range, "log_transform": log_transform},
    "clinical": {"standard": standard, "minmax": minmax, "robust": robust},
    "generic": {"standard": standard, "minmax": minmax, "robust": robust, "zscore": standard, "log2_scale": log2_zscore},
}


def normalize(long: DataFrame, kind: str = "generic", method: str | None = None, **options) -> DataFrame:
    """Dispatch by kind of measurement and method."""
    methods = METHODS.get(kind, METHODS["generic"])
    name = method or next(iter(methods))
    if name not in methods:
        raise PreprocessingError(f"{kind} has no method {name}; it has {', '.join(methods)}")
    return methods[name](long, **options)


@dataclass(frozen=True)
class FittedColumns:
    """Centre and divisor of every column of a wide table; ``transform`` is a projection and also runs on streams."""

    stats: Mapping[str, tuple[float, float]]
    logged: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (centre, divisor) in self.stats.items():
            x = clean_number(F.col(f"`{c}`"))
            x = F.when(x > -1, F.log2(x + 1)) if self.logged else x
            out[c] = (x - F.lit(centre)) / F.lit(divisor) if divisor else x
        return df.withColumns(out)


#: Methods whose statistics are a centre and a divisor of each column.
BY_COLUMN = ("standard", "zscore", "auto_scaling", "minmax", "range_scaling", "robust", "median_centering", "pareto_scaling", "log2_scale")
#: Methods that compare the features of a sample, or samples with each other; lengths are taken as equal.
BY_SAMPLE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tpm": lambda long: fpkm(long, None), "fpkm": lambda long: fpkm(long, None), "deseq2_size_factors": by_size_factor, "tmm": by_trimmed_mean, "quantile": quantile_normalize, "log_transform": log_transform,
}


def fit_columns(df: DataFrame, columns: Sequence[str], method: str = "standard") -> FittedColumns:
    """The statistics of ``method`` for number columns: one aggregation, for quartiles one over value counts.

    A divisor of 0, or of nothing, divides by 1; for ``log2_scale`` such columns stay logarithms.
    """
    if method not in BY_COLUMN:
        raise PreprocessingError(f"no method {method} for single columns; there are {', '.join(BY_COLUMN)}")
    columns = list(columns)
    if not columns:
        return FittedColumns({})
    clean = [clean_number(F.col(f"`{c}`")) for c in columns]
    logged = method == "log2_scale"
    if method in ("robust", "median_centering"):
        long = to_long(df.select(*[F.col(f"`{c}`") for c in columns]).withColumn("_k", F.lit(0)), "_k", columns)
        found = {r["feature"]: r for r in feature_quantiles(long, {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
        return FittedColumns({c: (found[c]["m"], (found[c]["q3"] - found[c]["q1"] or 1.0) if method == "robust" else 1.0) if c in found else (0.0, 1.0) for c in columns})
    clean = [F.log2(F.when(x > -1, x) + 1) for x in clean] if logged else clean
    first, second = {"minmax": (F.min, F.max), "range_scaling": (F.min, F.max), "pareto_scaling": (F.avg, F.stddev_samp), "log2_scale": (F.avg, F.stddev_samp)}.get(method, (F.avg, F.stddev_pop))
    row = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(clean) for n, f in (("a", first), ("b", second))]).first()
    stats = {}
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
        divisor = b - a if second is F.max else b**0.5 if method == "pareto_scaling" else b
        stats[c] = (a, divisor or (0.0 if logged else 1.0))
    return FittedColumns(stats, logged)


def normalize_wide(df: DataFrame, key: str, method: str = "log2_scale", columns: Sequence[str] | None = None) -> DataFrame:
    """A wide table with its number columns normalised by any of the methods; unknown ones are refused.

    Methods over samples go through the long form, in which one row per key is expected.
    """
    columns = list(columns if columns is not None else numeric_columns(df, [key]))
    if method in BY_COLUMN:
        return fit_columns(df, columns, method).transform(df)
    if method not in BY_SAMPLE:
        raise PreprocessingError(f"no normalisation {method}; there are {', '.join([*BY_COLUMN, *BY_SAMPLE])}")
    long = to_long(df, key, columns).withColumnRenamed(key, "sample")
    wide = to_wide(BY_SAMPLE[method](long), "sample", "feature", "value", columns)
    wide = wide.select(F.col("sample").alias("_key"), *[F.col(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(columns)])
    joined = df.join(wide, df[key] == wide["_key"], "left")
    return joined.select(*[F.col(f"_n{columns.index(c)}").alias(c) if c in columns else df[f"`{c}`"] for c in df.columns])
