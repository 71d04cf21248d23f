"""Imputation of wide tables: fitted fill values, nearest neighbours, and chained regressions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.errors import MissingDataError, PreprocessingError
from helixmill.functions.text import clean_number
from helixmill.operators.matrix import categorical_columns, feature_quantiles, numeric_columns, to_long
from helixmill.session import durable

UNKNOWN = "Unknown"
#: Rows with gaps that one pass over the donors serves.
QUERY_BLOCK = 20_000


@dataclass(frozen=True)
class Fills:
    """Fitted fill values; ``transform`` is a projection and also runs on streams."""

    numbers: Mapping[str, float | None]
    texts: Mapping[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        numbers = {c: F.coalesce(clean_number(F.col(f"`{c}`")), F.lit(v)) for c, v in self.numbers.items()}
        texts = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in self.texts.items()}
        return df.withColumns(numbers | texts)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent text of each column, the smallest of equals; ``Unknown`` where there is none."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("p")
    counts = df.select(pairs).filter("p.v IS NOT NULL").groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    found = {r["c"]: r["v"] for r in best.select("c", "b.v").collect()}
    return {c: found.get(c, UNKNOWN) for c in columns}


def fit_simple(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None, exclude: Sequence[str] = (), constant: float = 0.0, texts: Sequence[str] | None = None) -> Fills:
    """Fill values by ``strategy``: median, mean, most_frequent or constant; texts take their mode."""
    numbers = list(columns if columns is not None else numeric_columns(df, exclude))
    texts = list(texts if texts is not None else categorical_columns(df, exclude))
    clean = [clean_number(F.col(f"`{c}`")) for c in numbers]
    if strategy == "constant":
        values = dict.fromkeys(numbers, float(constant))
    elif strategy == "mean":
        row = df.agg(*[F.avg(x).alias(f"_{i}") for i, x in enumerate(clean)]).first() if numbers else ()
        values = dict(zip(numbers, row, strict=True))
    elif strategy in ("median", "most_frequent"):
        long = to_long(df.select(*[F.col(f"`{c}`") for c in numbers]).withColumn("_k", F.lit(0)), "_k", numbers) if numbers else None
        if not numbers:
            values = {}
        elif strategy == "median":
            values = dict.fromkeys(numbers) | {r["feature"]: r["m"] for r in feature_quantiles(long, {"m": 0.5}).collect()}
        else:
            best = long.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
            values = dict.fromkeys(numbers) | {r["feature"]: r["value"] for r in best.select("feature", "b.value").collect()}
    else:
        raise PreprocessingError(f"unknown strategy {strategy}")
    return Fills(values, modes(df, texts))


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def drop_sparse(df: DataFrame, threshold: float = 0.5, exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the columns whose missing share is at most ``threshold``."""
    columns = [c for c in df.columns if c not in exclude]
    shares = missing_shares(df, columns)
    return df.drop(*[c for c in columns if shares[c] > threshold])


def guard_missing(df: DataFrame, threshold: float = 0.3, exclude: Sequence[str] = ()) -> DataFrame:
    """As ``drop_sparse``, but a table that misses more than ``threshold`` as a whole is refused."""
    columns = [c for c in df.columns if c not in exclude]
    shares = missing_shares(df, columns)
    whole = sum(shares.values()) / max(len(shares), 1)
    if whole > threshold:
        raise MissingDataError(f"{whole:.1%} of the cells are missing; at most {threshold:.1%} may be")
    return df.drop(*[c for c in columns if shares[c] > threshold])


def nearest_donors(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(key, feature, donor, distance, value): the ``k`` nearest rows that have the missing feature.

    Distances are Euclidean over the features both rows have, scaled to all features. Rows with
    gaps are compared in blocks: each task keeps the k nearest of its own donors, and only
    these are shuffled. No pair of rows is ever materialised.
    """
    columns = list(columns)
    rows = durable(df.select(F.col(f"`{key}`").alias("key"), F.array(*[clean_number(F.col(f"`{c}`")) for c in columns]).alias("x")))
    gaps = rows.filter(F.exists("x", lambda v: v.isNull()))
    n = gaps.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    kind = dict(rows.dtypes)["key"]
    parts = []
    for b in range(blocks):
        mine = gaps if blocks == 1 else gaps.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        # QUERY_BLOCK rows on average, whatever the table's size
        block = mine.orderBy("key").toPandas()
        queries = np.array([[np.nan if v is None else v for v in x] for x in block["x"]], dtype=float).reshape(len(block), len(columns))
        shared = df.sparkSession.sparkContext.broadcast((block["key"].to_numpy(), queries, columns, k))
        parts.append(rows.mapInPandas(_local_nearest(shared), f"key {kind}, feature string, donor {kind}, distance double, value double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("key", "feature").orderBy("distance", "donor")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _local_nearest(shared):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, queries, columns, k = shared.value
        have_q = ~np.isnan(queries)
        filled_q = np.where(have_q, queries, 0.0)
        best: dict[tuple[int, int], list] = {}
        for pdf in batches:
            donors = np.array([[np.nan if v is None else v for v in x] for x in pdf["x"]], dtype=float).reshape(len(pdf), len(columns))
            names = pdf["key"].to_numpy()
            have_d = ~np.isnan(donors)
            filled_d = np.where(have_d, donors, 0.0)
            # differences of a few queries with all donors of the batch at a time: about 4 million numbers
            step = max(1, 4_000_000 // max(len(pdf) * len(columns), 1))
            for start in range(0, len(queries), step):
                hq, fq = have_q[start : start + step], filled_q[start : start + step]
                both = hq.astype(float) @ have_d.T.astype(float)
                gap = fq[:, None, :] - filled_d[None, :, :]
                gap *= hq[:, None, :] & have_d[None, :, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    distance = np.sqrt((gap * gap).sum(axis=2) * len(columns) / both)
                distance[both == 0] = np.inf
                for i in range(len(hq)):
                    for j in np.flatnonzero(~hq[i]):
                        d = np.where(have_d[:, j] & (names != keys[start + i]), distance[i], np.inf)
                        near = np.lexsort((names, d))[:k]
                        near = near[np.isfinite(d[near])]
                        if near.size:
                            held = best.setdefault((start + i, int(j)), [])
                            held += [(float(d[x]), names[x], float(donors[x, j])) for x in near]
                            held.sort(key=lambda t: (t[0], t[1]))
                            del held[k:]
        rows = [(keys[i], columns[j], name, d, v) for (i, j), held in best.items() for d, name, v in held]
        yield pd.DataFrame(rows, columns=["key", "feature", "donor", "distance", "value"])

    return work


def knn_cells(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """(key, feature, value) for every missing cell: the mean of the nearest donors, else of the column."""
    near = nearest_donors(df, key, columns, k)
    if weights == "distance":
        zero = F.max((F.col("distance") == 0).cast("int")) == 1
        exact = F.avg(F.when(F.col("distance") == 0, F.col("value")))
        away = F.col("distance") > 0
        inverse = F.sum(F.when(away, F.col("value") / nonzero_distance())) / F.sum(F.when(away, 1 / nonzero_distance()))
        mean = F.when(zero, exact).otherwise(inverse)
    else:
        mean = F.avg("value")
    filled = near.groupBy("key", "feature").agg(mean.alias("value"))
    long = to_long(df, key, columns)
    means = long.groupBy("feature").agg(F.avg("value").alias("_mean"))
    empty = long.filter("value IS NULL").select(F.col(f"`{key}`").alias("key"), "feature")
    return empty.join(filled, ["key", "feature"], "left").join(means, "feature").select("key", "feature", F.coalesce("value", "_mean").alias("value"))


def nonzero_distance():
    return F.when(F.col("distance") > 0, F.col("distance"))


def impute_knn(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """``df`` with the missing cells of ``columns`` filled; texts take their mode."""
    cells = knn_cells(df, key, columns, k, weights).groupBy("key").pivot("feature", list(columns)).agg(F.first("value"))
    cells = cells.select(F.col("key").alias("_key"), *[F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(columns)])
    out = df.join(cells, df[key] == cells["_key"], "left").withColumns({c: F.coalesce(clean_number(F.col(f"`{c}`")), F.col(f"_f{i}")) for i, c in enumerate(columns)})
    texts = categorical_columns(df, [key])
    return Fills({}, modes(df, texts)).transform(out.drop("_key", *[f"_f{i}" for i in range(len(columns))]))


def impute_chained(df: DataFrame, key: str, columns: Sequence[str], rounds: int = 10, trees: int = 10, seed: int = 42, tolerance: float = 1e-3) -> DataFrame:
    """Chained random-forest regressions: every column with gaps is predicted from the others.

    It ends after ``rounds``, or when no filled cell moved by more than ``tolerance`` deviations.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    columns = list(columns)
    moments = df.agg(*[f(clean_number(F.col(f"`{c}`"))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = [moments[f"m{i}"] or 0.0 for i in range(len(columns))]
    sd = [moments[f"s{i}"] or 1.0 for i in range(len(columns))]
    z = df.withColumns({f"_gap{i}": clean_number(F.col(f"`{c}`")).isNull() for i, c in enumerate(columns)})
    z = z.withColumns({f"_z{i}": F.coalesce((clean_number(F.col(f"`{c}`")) - mean[i]) / sd[i], F.lit(0.0)) for i, c in enumerate(columns)})
    shares = missing_shares(df, columns)
    for _ in range(rounds):
        z = z.withColumns({f"_b{i}": F.col(f"_z{i}") for i in range(len(columns))})
        for i in sorted((i for i, c in enumerate(columns) if shares[c] > 0), key=lambda i: shares[columns[i]]):
            inputs = [f"_z{j}" for j in range(len(columns)) if j != i]
            ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(z)
            model = RandomForestRegressor(featuresCol="_x", labelCol=f"_z{i}", predictionCol="_p", numTrees=trees, seed=seed).fit(ready.filter(~F.col(f"_gap{i}")))
            z = model.transform(ready).withColumn(f"_z{i}", F.when(F.col(f"_gap{i}"), F.col("_p")).otherwise(F.col(f"_z{i}"))).drop("_x", "_p")
        moved = F.greatest(*[F.abs(F.col(f"_z{i}") - F.col(f"_b{i}")) for i in range(len(columns))]) if len(columns) > 1 else F.abs(F.col("_z0") - F.col("_b0"))
        z = durable(z.withColumn("_moved", moved).drop(*[f"_b{i}" for i in range(len(columns))]))
        most = z.agg(F.max("_moved")).first()[0]
        z = z.drop("_moved")
        if most is None or most <= tolerance:
            break
    out = z.withColumns({c: F.when(F.col(f"_gap{i}"), F.col(f"_z{i}") * sd[i] + mean[i]).otherwise(clean_number(F.col(f"`{c}`"))) for i, c in enumerate(columns)})
    return out.drop(*[f"_gap{i}" for i in range(len(columns))], *[f"_z{i}" for i in range(len(columns))])


def impute(df: DataFrame, strategy: str = "knn", key: str | None = None, exclude: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Dispatch by strategy; a table without gaps comes back as it is, and by simple strategies so does every column without."""
    exclude = [*exclude, *([key] if key else [])]
    columns = numeric_columns(df, exclude)
    if strategy not in ("knn", "knn_distance", "median", "mean", "most_frequent", "constant", "iterative"):
        raise PreprocessingError(f"unknown strategy {strategy}")
    shares = missing_shares(df.withColumns({c: clean_number(F.col(f"`{c}`")) for c in columns}), [c for c in df.columns if c not in exclude])
    if not any(v > 0 for v in shares.values()):
        return df
    if strategy.startswith("knn") and key:
        return impute_knn(df, key, columns, k, "distance" if strategy == "knn_distance" else "uniform")
    if strategy == "iterative" and key:
        return impute_chained(df, key, columns)
    return fit_simple(df, "median" if strategy in ("knn", "knn_distance", "iterative") else strategy, [c for c in columns if shares[c] > 0], texts=[c for c in categorical_columns(df, exclude) if shares[c] > 0]).transform(df)
