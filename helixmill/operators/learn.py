"""Preparing and judging data for learning: splits, scaling, feature selection, models, outliers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.errors import ExportError
from helixmill.functions.text import clean_number
from helixmill.operators.matrix import by_feature, feature_quantiles, nonzero
from helixmill.operators.value_counts import quantiles
from helixmill.session import durable

def _v() -> Column:
    return F.col("value")


def split_column(key: Column, share: float = 0.2, seed: int = 42) -> Column:
    """test or train by a hash of the key: the same row always falls on the same side."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000), "test").otherwise("train")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the share of each label, by the order of a hash of the key.

    The threshold of a label is a quantile of its hashes, so no task sorts a whole class.
    """
    h = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 12).cast("double"))
    counts = h.groupBy(label, F.col("_h").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    cut = quantiles(counts, [label], {"_cut": share})
    return h.join(cut, label, "left").withColumn("split", F.when(F.col("_h") < F.col("_cut"), "test").otherwise("train")).drop("_h", "_cut")


def scale_by_train(long: DataFrame, method: str = "standard") -> DataFrame:
    """Scale (key, split, feature, value) rows by statistics of the train rows alone."""
    train = long.filter("split = 'train'").select("feature", "value")
    if method == "none":
        return long
    if method == "robust":
        s = feature_quantiles(train, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
        scaled = (_v() - F.col("mid")) / nonzero(F.col("q3") - F.col("q1"))
    elif method in ("standard", "minmax"):
        s = by_feature(train)
        scaled = (_v() - F.col("mean")) / nonzero(F.col("sd_pop")) if method == "standard" else (_v() - F.col("low")) / nonzero(F.col("high") - F.col("low"))
    else:
        raise ExportError(f"unknown scaling {method}")
    names = [c for c in s.columns if c != "feature"]
    return long.join(s, "feature", "left").withColumn("value", scaled).drop(*names)


def anova_f(long: DataFrame, label: str) -> DataFrame:
    """(feature, f): the ratio of variance between and within the classes."""
    known = long.filter(_v().isNotNull() & F.col(label).isNotNull())
    # sums around each feature's mean keep their digits
    mean = known.groupBy("feature").agg(F.avg("value").alias("m"))
    d = _v() - F.col("m")
    per = known.join(mean, "feature").groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    t = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("b")
    return t.filter("k > 1 AND n > k").select("feature", F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"))


def binned_information(long: DataFrame, label: str, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information in nats of the label and the feature cut at its quantiles."""
    probabilities = {f"_q{i}": i / bins for i in range(1, bins)}
    known = long.filter(_v().isNotNull() & F.col(label).isNotNull())
    cut = feature_quantiles(known, probabilities)
    b = sum(((_v() > F.col(q)).cast("int") for q in probabilities), F.lit(0))
    cells = known.join(cut, "feature").groupBy("feature", b.alias("b"), F.col(label).alias("l")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # bins times classes rows per feature
    wf = Window.partitionBy("feature")
    n, nb, nl = F.sum("n").over(wf), F.sum("n").over(wf.partitionBy("feature", "b")), F.sum("n").over(wf.partitionBy("feature", "l"))
    marked = cells.select("feature", "n", n.alias("t"), nb.alias("nb"), nl.alias("nl"))
    return marked.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))).alias("mi"))


def top_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(k)


def _vector(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    clean = df.select(F.col(label).cast("double").alias("label"), *[F.coalesce(clean_number(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in columns], *(["split"] if "split" in df.columns else []))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(clean)


def _forest(trees: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=5)


def eliminate(df: DataFrame, columns: Sequence[str], label: str, keep: int, step: float = 0.5, trees: int = 50, seed: int = 42) -> list[tuple[str, float]]:
    """Recursive elimination by forest importance: the weakest ``step`` share goes each round."""
    left = list(columns)
    while True:
        model = _forest(trees, seed).fit(_vector(df, left, label))
        ranked = sorted(zip(left, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
        if len(left) <= keep:
            return ranked
        left = [c for c, _ in ranked[: max(keep, int(len(left) * (1 - step)))]]


def evaluate(df: DataFrame, columns: Sequence[str], label: str, model: str = "random_forest", seed: int = 42) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Predictions (label, prediction, split) of a model fitted on the train rows, and its importances."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest

    kinds = {"random_forest": lambda: _forest(100, seed), "logistic": lambda: LogisticRegression(maxIter=50), "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=50))}
    if model not in kinds:
        raise ExportError(f"unknown model {model}")
    data = _vector(df, columns, label)
    fitted = kinds[model]().fit(data.filter("split = 'train'"))
    importance = sorted(zip(columns, fitted.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:20] if model == "random_forest" else []
    return fitted.transform(data).select("label", "prediction", "split"), importance


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("split", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(confused: DataFrame) -> DataFrame:
    """(split, n, accuracy) from a confusion table."""
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return confused.groupBy("split").agg(F.sum("n").alias("n"), (hit / F.sum("n")).alias("accuracy"))


def class_report(confused: DataFrame, split: str = "test") -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table."""
    c = confused.filter(F.col("split") == split)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    by_label = c.groupBy("label").agg(hit.alias("tp"), F.sum("n").alias("support"))
    by_pred = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = F.try_divide(F.col("tp"), F.col("predicted")), F.try_divide(F.col("tp"), F.col("support"))
    return by_label.join(by_pred, "label", "left").select("label", F.coalesce(p, F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    n = len(x)
    spans = x.max(axis=0) - x.min(axis=0) if n else np.zeros(0)
    if depth == 0 or n <= 1 or not (spans > 0).any():
        return ("leaf", n)
    j = int(rng.choice(np.flatnonzero(spans > 0)))
    cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
    left = x[:, j] < cut
    return ("node", j, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1))


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(key, score): isolation-forest anomaly scores on scaled columns (Liu, Ting and Zhou 2008).

    The trees grow from a sample of fixed size, chosen by hash; scoring is an Arrow UDF.
    """
    from helixmill.operators.fuse import scale_columns

    # read in two passes, and a projection this wide is optimised faster by itself
    scaled = durable(scale_columns(df.select(key, *columns), key))
    scaled = scaled.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns})
    picked = scaled.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(trees * sample // 4).select(*columns).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(picked))
    depth = int(np.ceil(np.log2(max(size, 2))))
    forest = [_grow(picked[rng.choice(len(picked), size, replace=False)], rng, depth) for _ in range(trees)] if size else []
    norm = _mean_path(size) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def walk(node: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
        if node[0] == "leaf":
            out[rows] += depth + _mean_path(node[1])
            return
        left = x[rows, node[1]] < node[2]
        for child, mine in ((node[3], rows[left]), (node[4], rows[~left])):
            if len(mine):
                walk(child, x, mine, depth + 1, out)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
        total = np.zeros(len(m))
        for tree in shared.value:
            walk(tree, m, np.arange(len(m)), 0, total)
        return pd.Series(2.0 ** (-total / max(len(shared.value), 1) / norm))

    return scaled.select(key, score(F.array(*[F.col(f"`{c}`") for c in columns])).alias("score"))


def isolation_outliers(scores: DataFrame, contamination: float = 0.05) -> DataFrame:
    """The ``contamination`` share of rows with the highest scores."""
    counts = scores.groupBy(F.lit("s").alias("k"), F.col("score").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    cut = quantiles(counts, ["k"], {"cut": 1 - contamination}).first()
    return scores.filter(F.col("score") > F.lit(cut["cut"] if cut else None))
