"""Dimension reduction: PCA, PLS, ICA and NMF over wide tables.

Each needs only sums over the rows that are as large as the number of features allows
(Gram matrices of p by p numbers at most), which partitions add up by themselves; rows are
never gathered. What is fitted is small and is applied as a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.errors import IntegrationError
from helixmill.functions.text import clean_number
from helixmill.session import durable

#: Features a Gram matrix is formed for; 4000 squared numbers are 128 MB.
MOST_FEATURES = 4000


@dataclass(frozen=True)
class Reduced:
    """Scores per row, loadings (feature by component) and the share of variance of each component."""

    scores: DataFrame
    loadings: np.ndarray
    ratios: np.ndarray
    columns: list[str]


def _clean(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(clean_number(F.col(f"`{c}`")), F.lit(float("nan"))) for c in columns]


def sums_over(df: DataFrame, columns: Sequence[str], work: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``work(block)`` (an array of ``width`` numbers) over all blocks of rows."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += work(pdf.to_numpy(dtype=float)).ravel()
        yield pd.DataFrame({"x": [total.tolist()]})

    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(_clean(df, columns))]).mapInPandas(local, "x array<double>")
    # the partial sums meet in pairs by position: one number per position and partition
    added = parts.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).toPandas()
    out = np.zeros(width)
    out[added["pos"].to_numpy()] = added["s"].to_numpy()
    return out


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, X'X) with missing values taken as the column's mean."""
    p = len(columns)
    if p > MOST_FEATURES:
        raise IntegrationError(f"{p} features; a Gram matrix holds {MOST_FEATURES}. Use pca_long, which takes any number")
    row = df.agg(*[F.avg(clean_number(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([row[i] if row[i] is not None else 0.0 for i in range(p)])

    def work(x: np.ndarray) -> np.ndarray:
        # centred before they are multiplied: no digits are lost where means are large
        x = np.where(np.isnan(x), mean, x) - mean
        return np.concatenate([[len(x)], (x.T @ x).ravel()])

    s = sums_over(df, columns, work, 1 + p * p)
    return s[0], mean, s[1:].reshape(p, p)


def project(df: DataFrame, key: str, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prefix: str) -> DataFrame:
    """(key, {prefix}1, ...): the centred, scaled rows times the weights, in Arrow batches."""
    kind, names = dict(df.dtypes)[key], [f"{prefix}{k + 1}" for k in range(weights.shape[1])]
    if not names:
        return df.select(key)
    turned = weights / np.asarray(scale, dtype=float)[:, None]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf.iloc[:, 1:].to_numpy(dtype=float)
            scores = np.where(np.isnan(x), 0.0, x - mean) @ turned
            yield pd.DataFrame({key: pdf.iloc[:, 0], **{n: scores[:, k] for k, n in enumerate(names)}})

    clean = df.select(key, *[c.alias(f"c{i}") for i, c in enumerate(_clean(df, columns))])
    return clean.mapInPandas(work, f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in names))


#: Samples of a long matrix with any number of features; their products with each other are 128 MB.
MOST_SAMPLES = 4000


def pca_long(long: DataFrame, components: int, scale: bool = True) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Principal components of a long matrix (sample, feature, value) of any number of features.

    The scores (sample, PC1, ...), the loadings (feature, PC1, ...) and the shares of variance. Samples by
    samples products are added up over the features, so only the number of samples is bounded (``MOST_SAMPLES``). Missing
    values are the feature's mean; the largest loading of each component is positive.
    """
    spark = long.sparkSession
    samples = [r[0] for r in long.select("sample").distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    n = len(samples)
    if n > MOST_SAMPLES:
        raise IntegrationError(f"more than {MOST_SAMPLES} samples; pivot the features and use pca")
    kind = dict(long.dtypes)["sample"]
    numbers = spark.createDataFrame(list(zip(samples, range(n))), f"sample {kind}, i int")
    cells = long.filter("value IS NOT NULL").join(F.broadcast(numbers), "sample").groupBy("feature").agg(F.collect_list(F.struct("i", "value")).alias("x"))
    # a feature has at most MOST_SAMPLES cells
    vectors = durable(cells)

    def standardised(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), n))
        for row, x in zip(out, pdf["x"]):
            at, v = np.array([e["i"] for e in x]), np.array([e["value"] for e in x], dtype=float)
            row[at] = v - v.mean()
            sd = np.sqrt((row * row).sum() / n)
            if scale and sd > 0:
                row /= sd
        return out

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            z = standardised(pdf)
            total += z.T @ z
        yield pd.DataFrame({"i": np.arange(n, dtype="int32"), "row": total.tolist()})

    added = vectors.mapInPandas(products, "i int, row array<double>").select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("s")).toPandas()
    k = np.zeros((n, n))
    k[added["i"].to_numpy(), added["pos"].to_numpy()] = added["s"].to_numpy()
    # no feature: no variance
    values, u = np.linalg.eigh(k) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[: min(components, n)]
    values, root = np.maximum(values, 0), np.sqrt(np.maximum(values[order], 1e-300))
    u = u[:, order]
    names = [f"PC{c + 1}" for c in range(len(order))]

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = standardised(pdf) @ u / root
            yield pd.DataFrame({"feature": pdf["feature"], **{c: w[:, j] for j, c in enumerate(names)}})

    loadings = durable(vectors.mapInPandas(weights, "feature string, " + ", ".join(f"{c} double" for c in names)))
    largest = loadings.agg(*[F.max(F.struct(F.abs(c).alias("s"), "feature", F.col(c).alias("w")))["w"].alias(c) for c in names]).first()
    sign = np.array([-1.0 if (largest[c] or 0.0) < 0 else 1.0 for c in names])
    scores = spark.createDataFrame([(s, *[float(x) for x in row]) for s, row in zip(samples, u * root * sign)], f"sample {kind}, " + ", ".join(f"{c} double" for c in names))
    turned = loadings.select("feature", *[(F.col(c) * float(g)).alias(c) for c, g in zip(names, sign)])
    return scores, turned, values[order] / (values.sum() or 1.0)


def pca(df: DataFrame, key: str, columns: Sequence[str], components: int, scale: bool = False) -> Reduced:
    """Principal components of centred (and scaled) features; the largest loading of each is positive."""
    columns = list(columns)
    n, mean, xx = gram(df, columns)
    sd = np.sqrt(np.diag(xx) / max(n, 1))
    sd = np.where((sd > 0) & scale, sd, 1.0)
    values, vectors = np.linalg.eigh(xx / np.outer(sd, sd) / max(n - 1, 1))
    order = np.argsort(-values)[: min(components, len(columns))]
    values, vectors = np.maximum(values, 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    total = values.sum()
    return Reduced(project(df, key, columns, mean, sd, vectors, "PC"), vectors, values[order] / (total or 1.0), columns)


def multi_view_pca(views: Mapping[str, DataFrame], key: str, components: int) -> Reduced:
    """PCA over the scaled features of all views; feature names are ``{view}_{column}``."""
    from helixmill.operators.fuse import early

    joined = early(views, key, scaling="none")
    return pca(joined, key, [c for c in joined.columns if c != key], components, scale=True)


def spectrum(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Condition number and ratio of the two largest eigenvalues of the covariance."""
    n, _, xx = gram(df, columns)
    if len(columns) < 2 or n <= len(columns):
        return {}
    values = np.sort(np.linalg.eigvalsh(xx / (n - 1)))[::-1]
    return {"condition_number": float(values[0] / values[-1]) if values[-1] > 0 else float("inf"), "first_to_second": float(values[0] / values[1]) if values[1] > 0 else float("inf")}


def loading_rows(spark, reduced: Reduced, views: Sequence[str] = ()) -> DataFrame:
    """(view, feature, component, loading)."""
    view = lambda c: next((v for v in views if c.startswith(f"{v}_")), "")
    rows = [(view(c), c, k + 1, float(reduced.loadings[i, k])) for i, c in enumerate(reduced.columns) for k in range(reduced.loadings.shape[1])]
    return spark.createDataFrame(rows, "view string, feature string, component int, loading double")


def top_loadings(rows: DataFrame, n: int = 10, components: int = 5) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("view", "component").orderBy(F.desc(F.abs("loading")), "feature")
    return rows.filter(F.col("component") <= components).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pls(df: DataFrame, key: str, columns: Sequence[str], target: str, components: int) -> tuple[Reduced, float]:
    """Partial least squares for one target and the R2 of its fit, from one pass of cross products."""
    columns = list(columns)
    n, mean, xx = gram(df, [*columns, target])
    sd = np.sqrt(np.diag(xx) / n)
    sd[sd == 0] = 1.0
    c = xx / np.outer(sd, sd)
    a, b, yy = c[:-1, :-1].copy(), c[:-1, -1].copy(), c[-1, -1]
    weights, loads, explained = [], [], 0.0
    rotation = np.eye(len(columns))
    for _ in range(min(components, len(columns))):
        w = b / (np.linalg.norm(b) or 1.0)
        tt = float(w @ a @ w)
        if tt <= 1e-12:
            break
        p = a @ w / tt
        q = float(b @ w) / tt
        explained += q * q * tt
        weights.append(rotation @ w)
        loads.append(p)
        # deflation in the cross products alone
        rotation = rotation @ (np.eye(len(columns)) - np.outer(w, p))
        a = a - tt * np.outer(p, p)
        b = b - tt * q * p
    r = np.array(weights).T if weights else np.zeros((len(columns), 0))
    return Reduced(project(df, key, columns, mean[:-1], sd[:-1], r, "PLS"), np.array(loads).T if loads else r, np.zeros(r.shape[1]), columns), float(explained / yy) if yy else 0.0


def ica(df: DataFrame, key: str, columns: Sequence[str], components: int, rounds: int = 1000, seed: int = 42, tolerance: float = 1e-4) -> Reduced:
    """FastICA with tanh: whitening from one pass, then a pass of sums for each round, until no direction turns by more than ``tolerance``."""
    columns = list(columns)
    n, mean, xx = gram(df, columns)
    values, vectors = np.linalg.eigh(xx / n)
    order = np.argsort(-values)[:components]
    whiten = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    k = whiten.shape[1]
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        def work(x: np.ndarray, w=w) -> np.ndarray:
            z = (np.where(np.isnan(x), mean, x) - mean) @ whiten
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0)])

        s = sums_over(df, columns, work, k * k + k) / n
        after = s[: k * k].reshape(k, k) - s[k * k :, None] * w
        u, _, v = np.linalg.svd(after)
        after = u @ v
        done = np.abs(np.abs((after * w).sum(axis=1)) - 1).max() < tolerance
        w = after
        if done:
            break
    unmix = whiten @ w.T
    return Reduced(project(df, key, columns, mean, np.ones(len(columns)), unmix, "IC"), unmix, np.zeros(k), columns)


@dataclass(frozen=True)
class Factors:
    scores: DataFrame
    parts: np.ndarray
    losses: list[float]


def nmf(df: DataFrame, key: str, columns: Sequence[str], components: int, rounds: int = 1000, inner: int = 20, seed: int = 42, tolerance: float = 1e-4) -> Factors:
    """Non-negative factors of the table, shifted to be non-negative; ``losses`` falls from round to round.

    A row's weights follow from the parts by multiplicative updates, so no state is kept
    between rounds but the parts; a round is one pass that adds up k by (k + p) numbers. It ends
    when a round lowers the loss by less than ``tolerance`` of the first loss.
    """
    columns = list(columns)
    p, k = len(columns), components
    row = df.agg(*[F.min(clean_number(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([min(row[i] or 0.0, 0.0) for i in range(p)])

    def rows_of(x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), 0.0, x - shift) + 1e-10

    def weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = np.full((len(x), k), max(x.mean(), 1e-6) / k)
        xh, hh = x @ h.T, h @ h.T
        for _ in range(inner):
            w *= xh / np.maximum(w @ hh, 1e-12)
        return w

    h = np.random.default_rng(seed).uniform(0.1, 1.0, size=(k, p))
    losses: list[float] = []
    for _ in range(rounds):
        def work(x: np.ndarray, h=h) -> np.ndarray:
            x = rows_of(x)
            w = weights(x, h)
            return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [((x - w @ h) ** 2).sum()]])

        s = sums_over(df, columns, work, k * p + k * k + 1)
        wx, ww = s[: k * p].reshape(k, p), s[k * p : -1].reshape(k, k)
        losses.append(float(s[-1]))
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * losses[0]:
            break
        for _ in range(inner):
            h = h * wx / np.maximum(ww @ h, 1e-12)

    kind = dict(df.dtypes)[key]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = weights(rows_of(pdf.iloc[:, 1:].to_numpy(dtype=float)), h) if len(pdf) else np.zeros((0, k))
            yield pd.DataFrame({key: pdf.iloc[:, 0], **{f"NMF{i + 1}": w[:, i] for i in range(k)}})

    clean = df.select(key, *[c.alias(f"c{i}") for i, c in enumerate(_clean(df, columns))])
    return Factors(clean.mapInPandas(score, f"`{key}` {kind}, " + ", ".join(f"NMF{i + 1} double" for i in range(k))), h, losses)


def reduce(df: DataFrame, key: str, columns: Sequence[str], method: str, components: int, target: str | None = None) -> DataFrame:
    """Scores by method; ``mofa`` is its documented fallback, PCA over the scaled features."""
    if method in ("pca", "mofa"):
        return pca(df, key, columns, components, scale=True).scores
    if method == "pls":
        return pls(df, key, columns, target, components)[0].scores if target else pca(df, key, columns, components, scale=True).scores
    if method == "ica":
        return ica(df, key, columns, components).scores
    if method == "nmf":
        return nmf(df, key, columns, components).scores
    raise IntegrationError(f"unknown method {method}")
