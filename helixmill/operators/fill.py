"""Filling missing values from similar records, with a mark on every filled cell.

Numbers: a mixed-effects prediction. The value is a general mean plus an effect of every
group (site, stage, ...), of the load (time) and of the record's subject; each effect is
the mean of what is left, shrunk by n*s2u/(n*s2u+s2e), with the variances by moments.
Group and time effects are fitted by backfitting on cells of (count, sum), not on rows.

Categories: a multinomial logit model with a shrunk effect of every level of every factor on every class, fitted on cells of
class counts by Newton steps for one factor after the other; numbers take part by their sixths. A subject's own classes
are joined to that as a Dirichlet-multinomial random effect, whose weight is the one that predicts
best each row of a subject from its others.

Cells are as many as there are combinations of levels. Up to ``MOST_CELLS`` of them are fitted
in one process, more of them by the same steps on the cluster, with the same result. Only rows with a gap
meet the effect tables; complete rows are shuffled only where their subject's residuals are added up.

Defined cases: NULL, NaN, blank and impossible values are gaps; a group not seen, or NULL,
has effect 0; ids of nothing but punctuation or one repeated character, and ``PLACEHOLDERS``, are no subject; with no usable
value at all the gap stays NULL but is still marked; repeated rows weigh as often as they occur; ties between classes go to the
first class; empty tables stay empty.  Further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.text import clean_number, fold, id_key, is_blank
from helixmill.operators.value_counts import quantiles
from helixmill.session import durable

STAGES = ["I", "II", "III", "IV"]
#: Cells that are fitted in the driver's process: some tens of megabytes.
MOST_CELLS = 200_000
#: Weight of the prior that draws effects on classes to 0.
RIDGE = 4.0
#: Weights of the model beside a subject's own classes, of which the best is taken.
SUBJECT_PRIORS = [0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 20.0]
SWEEPS = 3
#: Parts by size that a number takes part in a model of classes with.
PARTS = 6

# Texts that stand where an id is not known, as letters and digits in upper case.
PLACEHOLDERS = ["NA", "N", "NAN", "NULL", "NONE", "NIL", "UNKNOWN", "UNK", "UK", "ND", "NK", "NR", "TBD", "TBA", "MISSING", "NOTAVAILABLE", "NOTKNOWN", "NOTDONE", "NOID", "ANON", "ANONYMOUS", "ANONYMISED", "TEST", "DUMMY", "PENDING", "UNBEKANNT", "INCONNU", "DESCONOCIDO"]


def usable_number(value: Column, low: float, high: float | None = None, low_open: bool = False) -> Column:
    number = clean_number(value)
    ok = (number > low) if low_open else (number >= low)
    if high is not None:
        ok = ok & (number <= high)
    return F.when(ok, number)


def stage_of(text: Column) -> Column:
    """The stage I to IV a text means, else NULL."""
    plain = F.regexp_replace(fold(text), "[^a-z0-9Ⅰ-Ⅳⅰ-ⅳ]", "")
    core = F.regexp_extract(plain, "^(?:ajcc|uicc|figo|tnm)?(?:[pc]?(?:stage|stadium|stade|estadio|stadio|stad|stg|st))?(iv|i{1,3}|[1-4]|one|two|three|four|[Ⅰ-Ⅳⅰ-ⅳ])(?:[abc][0-9]?)?$", 1)
    return (
        F.when(core.isin("i", "1", "one", "Ⅰ", "ⅰ"), "I").when(core.isin("ii", "2", "two", "Ⅱ", "ⅱ"), "II")
        .when(core.isin("iii", "3", "three", "Ⅲ", "ⅲ"), "III").when(core.isin("iv", "4", "four", "Ⅳ", "ⅳ"), "IV")
    )


def subject_key(column: str) -> Column:
    """The subject that an id means; NULL where it means none."""
    value = F.col(f"`{column}`")
    key = id_key(value)
    return F.when(~is_blank(value) & (key != "") & ~key.isin(PLACEHOLDERS) & ~key.rlike("^(.)\\1*$"), key)


@dataclass(frozen=True)
class Variances:
    between: float
    within: float

    def effect(self, n: Column, s: Column) -> Column:
        return s * F.lit(self.between) / (n * F.lit(self.between) + F.lit(self.within))


def _variances(levels: float, n: float, nn: float, between_ss: float, s: float, total_ss: float) -> Variances:
    """By moments, from the number of levels and sums over them of n, n*n, s*s/n and s, and the sum of squares of all rows."""
    if n <= 1 or levels < 1:
        return Variances(0.0, 1.0)
    within = max((total_ss - between_ss) / max(n - levels, 1.0), 1e-12)
    spread = n - nn / n
    return Variances(max((between_ss - s * s / n - (levels - 1) * within) / spread, 0.0) if spread > 0 else 0.0, within)


def _level_sums(levels: DataFrame) -> list[Column]:
    n, s = F.col("n"), F.col("s")
    return [F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n.cast("double") * n), F.lit(0.0)), F.coalesce(F.sum(s * s / n), F.lit(0.0)), F.coalesce(F.sum(s), F.lit(0.0))]


def _table(spark: SparkSession, effects: dict, value: str) -> DataFrame:
    return spark.createDataFrame(list(effects.items()), f"_level string, _u {value}")


def _number_effects(cell: DataFrame, groups: Sequence[str], sweeps: int, most_cells: int) -> tuple[float, dict[str, DataFrame]]:
    """The mean and per group (_level, _u), by backfitting on cells (groups, n, sy, syy)."""
    total = cell.agg(F.sum("n").alias("n"), F.sum("sy").alias("s"), F.count(F.lit(1)).alias("cells")).first()
    mean = total["s"] / total["n"]
    sweeps = sweeps if len(groups) > 1 else 1
    if total["cells"] <= most_cells:
        c = cell.toPandas()
        n, sy, syy = (c[x].to_numpy(dtype=float) for x in ("n", "sy", "syy"))
        fit, codes, names, effects = np.full(len(c), mean), {}, {}, {}
        for g in groups:
            codes[g], names[g] = pd.factorize(c[g])
            effects[g] = np.zeros(len(names[g]) + 1)
        for _ in range(sweeps):
            for g in groups:
                # a missing level is the last one and keeps the effect 0
                at = np.where(codes[g] < 0, len(names[g]), codes[g])
                fit = fit - effects[g][at]
                left = sy - n * fit
                size, s = np.bincount(at, n, len(names[g]) + 1), np.bincount(at, left, len(names[g]) + 1)
                there = size > 0
                v = _variances(there.sum(), size.sum(), (size * size).sum(), (s[there] ** 2 / size[there]).sum(), s.sum(), (syy - 2 * fit * sy + n * fit * fit).sum())
                effects[g] = s * v.between / (size * v.between + v.within)
                effects[g][-1] = 0.0
                fit = fit + effects[g][at]
        return mean, {g: _table(cell.sparkSession, {str(k): float(u) for k, u in zip(names[g], effects[g])}, "double") for g in groups}
    cell, found = cell.withColumn("fit", F.lit(mean)), {}
    for _ in range(sweeps):
        for g in groups:
            if g in found:
                cell = cell.join(found[g], cell[g] == found[g]["_level"], "left").withColumn("fit", F.col("fit") - F.coalesce("_u", F.lit(0.0))).drop("_level", "_u")
            left = F.col("sy") - F.col("n") * F.col("fit")
            rss = cell.agg(F.sum(F.col("syy") - 2 * F.col("fit") * F.col("sy") + F.col("n") * F.col("fit") * F.col("fit"))).first()[0]
            levels = durable(cell.groupBy(F.col(g).alias("_level")).agg(F.sum("n").alias("n"), F.sum(left).alias("s")))
            v = _variances(*levels.agg(*_level_sums(levels)).first(), rss)
            found[g] = durable(levels.filter("_level IS NOT NULL").select("_level", v.effect(F.col("n"), F.col("s")).alias("_u")))
            cell = durable(cell.join(found[g], cell[g] == found[g]["_level"], "left").withColumn("fit", F.col("fit") + F.coalesce("_u", F.lit(0.0))).drop("_level", "_u"))
    return mean, found


def fill_number(
    rows: DataFrame, column: str, usable: Column, factors: Sequence[str], subject: str | Column | None, log: bool = False,
    low: float | None = None, high: float | None = None, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``rows`` with ``column`` filled and ``{column}_filled`` added. ``subject`` is a column of ids, or an expression of ``subject_key``s."""
    mark = f"{column}_filled"
    y = F.log1p(usable) if log else usable
    base = rows.withColumn("_v", usable).withColumn("_y", y)
    groups = [f"_f{i}" for i in range(len(factors))]
    keys = [F.col(f"`{f}`").cast("string").alias(g) for f, g in zip(factors, groups, strict=True)]
    seen = base.filter("_y IS NOT NULL")
    cell = durable(seen.select(*keys, "_y").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("syy")))
    complete = base.filter("_v IS NOT NULL").withColumn(mark, F.lit(False)).drop("_y")
    gaps = base.filter("_v IS NULL").drop("_y")
    if not cell.agg(F.sum("n")).first()[0]:
        predicted = gaps.withColumn("_p", F.lit(None).cast("double"))
    else:
        mean, effects = _number_effects(cell, groups, sweeps, most_cells)

        def fitted(df: DataFrame) -> DataFrame:
            df = df.withColumn("_fit", F.lit(mean))
            for f, g in zip(factors, groups, strict=True):
                e = effects[g].withColumnsRenamed({"_level": f"_l{g}", "_u": f"_u{g}"})
                df = df.join(e, F.col(f"`{f}`").cast("string") == F.col(f"_l{g}"), "left").withColumn("_fit", F.col("_fit") + F.coalesce(f"_u{g}", F.lit(0.0))).drop(f"_l{g}", f"_u{g}")
            return df

        predicted = fitted(gaps)
        if subject is not None:
            r = F.col("_y") - F.col("_fit")
            key = subject if isinstance(subject, Column) else subject_key(subject)
            left = fitted(seen).select(key.alias("_subject"), r.alias("r")).filter("_subject IS NOT NULL")
            own = durable(left.groupBy("_subject").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss")))
            v = _variances(*own.agg(*_level_sums(own), F.coalesce(F.sum("ss"), F.lit(0.0))).first())
            own = own.select("_subject", v.effect(F.col("n"), F.col("s")).alias("_us"))
            predicted = predicted.withColumn("_at", key).join(own, F.col("_at") == F.col("_subject"), "left").withColumn("_fit", F.col("_fit") + F.coalesce("_us", F.lit(0.0))).drop("_at", "_subject", "_us")
        p = F.expm1("_fit") if log else F.col("_fit")
        if low is not None:
            p = F.greatest(p, F.lit(low))
        if high is not None:
            p = F.least(p, F.lit(high))
        predicted = predicted.withColumn("_p", p).drop("_fit")
    filled = predicted.withColumn("_v", F.col("_p")).drop("_p").withColumn(mark, F.lit(True))
    out = complete.unionByName(filled.select(*complete.columns))
    return out.withColumn(column, F.col("_v")).drop("_v")


def _newton(counts: np.ndarray, gradient: np.ndarray, curve: np.ndarray, effect: np.ndarray, ridge: float) -> np.ndarray:
    """The effects of every level after one Newton step: gradient sums (levels, k), curvature sums (levels, k, k)."""
    k = effect.shape[1]
    return effect + np.linalg.solve(curve + ridge * np.eye(k), (gradient - ridge * effect)[:, :, None])[:, :, 0]


def _class_effects(cell: DataFrame, groups: Sequence[str], classes: int, start: np.ndarray, sweeps: int, most_cells: int) -> dict[str, DataFrame]:
    """Per group (_level, _u): an effect on every class, by Newton steps on cells (groups, c0, c1, ...)."""
    spark, k = cell.sparkSession, classes
    if cell.limit(most_cells + 1).count() <= most_cells:
        c = cell.toPandas()
        counts = c[[f"c{i}" for i in range(k)]].to_numpy(dtype=float)
        n = counts.sum(axis=1)
        eta, codes, names, effects = np.tile(start, (len(c), 1)), {}, {}, {}
        for g in groups:
            codes[g], names[g] = pd.factorize(c[g])
            effects[g] = np.zeros((len(names[g]) + 1, k))
        for _ in range(sweeps):
            for g in groups:
                at, size = np.where(codes[g] < 0, len(names[g]), codes[g]), len(names[g]) + 1
                p = np.exp(eta - eta.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                gradient = np.stack([np.bincount(at, counts[:, i] - n * p[:, i], size) for i in range(k)], axis=1)
                curve = np.stack([np.stack([np.bincount(at, n * (p[:, i] * (i == j) - p[:, i] * p[:, j]), size) for j in range(k)], axis=1) for i in range(k)], axis=1)
                after = _newton(counts, gradient, curve, effects[g], RIDGE)
                after[-1] = 0.0
                eta = eta + (after - effects[g])[at]
                effects[g] = after
        return {g: _table(spark, {str(level): [float(x) for x in u] for level, u in zip(names[g], effects[g])}, "array<double>") for g in groups}
    cell = cell.withColumn("n", sum(F.col(f"c{i}") for i in range(k))).withColumn("eta", F.array(*[F.lit(float(s)) for s in start]))
    found: dict[str, DataFrame] = {}

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            old = np.array([np.zeros(k) if u is None else np.asarray(u, dtype=float) for u in b["_u"]]).reshape(len(b), k)
            gradient = np.array(b["g"].tolist(), dtype=float).reshape(len(b), k)
            new = _newton(gradient, gradient, np.array(b["h"].tolist(), dtype=float).reshape(len(b), k, k), old, RIDGE)
            yield pd.DataFrame({"_level": b["_level"], "_u": new.tolist(), "_d": (new - old).tolist()})

    for _ in range(sweeps):
        for g in groups:
            weight = F.transform("eta", lambda x: F.exp(x - F.array_max("eta")))
            ready = cell.withColumn("w", weight).withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, y: a + y)))
            p = [F.col("p")[i] for i in range(k)]
            levels = ready.filter(F.col(g).isNotNull()).groupBy(F.col(g).alias("_level")).agg(
                F.array(*[F.sum(F.col(f"c{i}") - F.col("n") * p[i]) for i in range(k)]).alias("g"),
                F.array(*[F.sum(F.col("n") * ((p[i] if i == j else F.lit(0.0)) - p[i] * p[j])) for i in range(k) for j in range(k)]).alias("h"))
            old = found[g].select("_level", "_u") if g in found else spark.createDataFrame([], "_level string, _u array<double>")
            moved = durable(levels.join(old, "_level", "left").select("_level", "g", "h", "_u").mapInPandas(step, "_level string, _u array<double>, _d array<double>"))
            found[g] = moved.select("_level", "_u")
            d = moved.select(F.col("_level").alias("_at"), "_d")
            cell = durable(cell.join(d, cell[g] == d["_at"], "left").withColumn("eta", F.when(F.col("_d").isNull(), F.col("eta")).otherwise(F.zip_with("eta", "_d", lambda a, b: a + b))).drop("_at", "_d"))
    return found


def _parts_of(rows: DataFrame, numbers: Sequence[str], parts: int) -> dict[str, list[float]]:
    """Inner bounds of ``parts`` parts of each number, equally large as far as ties allow."""
    if not numbers:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), clean_number(F.col(f"`{c}`")).alias("value")) for c in numbers])).alias("p")
    counts = rows.select(pairs).select("p.*").groupBy("c", "value").agg(F.count(F.lit(1)).alias("cnt"))
    found = {r["c"]: r for r in quantiles(counts, ["c"], {f"q{i}": i / parts for i in range(1, parts)}).collect()}
    return {c: sorted({found[c][f"q{i}"] for i in range(1, parts)}) if c in found else [] for c in numbers}


def fill_category(
    rows: DataFrame, column: str, usable: Column, classes: Sequence[str], factors: Sequence[str], subject: str | Column | None,
    numbers: Sequence[str] = (), sweeps: int = SWEEPS, most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``rows`` with ``column`` in canonical spelling, filled, and ``{column}_filled`` and ``{column}_share`` added.

    The share is the probability that the model gives the class of a filled cell, 1 for one that was there.
    """
    mark, share, k = f"{column}_filled", f"{column}_share", len(classes)
    base = rows.withColumn("_v", usable)
    complete = base.filter("_v IS NOT NULL").withColumn(mark, F.lit(False)).withColumn(share, F.lit(1.0))
    gaps = base.filter("_v IS NULL")
    bounds = _parts_of(rows, numbers, PARTS)
    part = lambda c: F.when(clean_number(F.col(f"`{c}`")).isNotNull(), sum((clean_number(F.col(f"`{c}`")) > b).cast("int") for b in bounds[c]) + F.lit(0))
    inputs = [F.col(f"`{f}`").cast("string") for f in factors] + [part(c).cast("string") for c in numbers]
    groups = [f"_f{i}" for i in range(len(inputs))]
    keyed = lambda df: df.withColumns(dict(zip(groups, inputs, strict=True)))
    tally = [F.count(F.when(F.col("_v") == c, 1)).alias(f"c{i}") for i, c in enumerate(classes)]
    seen = base.filter("_v IS NOT NULL")
    cell = durable(keyed(seen).groupBy(*groups).agg(*tally)) if groups else durable(seen.agg(*tally))
    total = cell.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(k)]).first()
    if not sum(total):
        predicted = gaps.withColumn("_p", F.lit(None).cast("double"))
    else:
        start = np.log((np.array(total, dtype=float) + 0.5) / (sum(total) + 0.5 * k))
        effects = _class_effects(cell, groups, k, start, sweeps, most_cells)

        def shares_of(df: DataFrame) -> DataFrame:
            df = keyed(df).withColumn("_eta", F.array(*[F.lit(float(s)) for s in start]))
            for g in groups:
                e = effects[g].withColumnsRenamed({"_level": f"_l{g}", "_u": f"_u{g}"})
                df = df.join(e, F.col(g) == F.col(f"_l{g}"), "left").withColumn("_eta", F.when(F.col(f"_u{g}").isNull(), F.col("_eta")).otherwise(F.zip_with("_eta", f"_u{g}", lambda a, b: a + b))).drop(f"_l{g}", f"_u{g}", g)
            df = df.withColumn("_w", F.transform("_eta", lambda x: F.exp(x - F.array_max("_eta"))))
            return df.withColumn("_p", F.transform("_w", lambda x: x / F.aggregate("_w", F.lit(0.0), lambda a, y: a + y))).drop("_eta", "_w")

        predicted = shares_of(gaps)
        if subject is not None:
            key = subject if isinstance(subject, Column) else subject_key(subject)
            own = seen.select(key.alias("_subject"), "_v").filter("_subject IS NOT NULL").groupBy("_subject").agg(*tally)
            own = durable(own.select("_subject", F.array(*[F.col(f"c{i}").cast("double") for i in range(k)]).alias("_own")))
            size = F.aggregate("_own", F.lit(0.0), lambda a, x: a + x)
            # how well each row of a subject is foretold by its others beside the general shares, for every weight
            general = np.exp(start) / np.exp(start).sum()
            n = [F.col("_own")[i] for i in range(k)]
            told = [F.sum(sum(F.when(n[i] > 0, n[i] * F.log((n[i] - 1 + a * float(general[i])) / (sum(n) - 1 + a))).otherwise(0.0) for i in range(k))) for a in SUBJECT_PRIORS]
            scores = own.filter(size > 1).agg(*told).first()
            weight = max(zip(scores, SUBJECT_PRIORS))[1] if scores[0] is not None else 1.0
            predicted = predicted.withColumn("_at", key).join(own, F.col("_at") == F.col("_subject"), "left").drop("_at", "_subject")
            mixed = F.zip_with("_own", "_p", lambda n, p: (n + F.lit(weight) * p) / (size + F.lit(weight)))
            predicted = predicted.withColumn("_p", F.when(F.col("_own").isNull(), F.col("_p")).otherwise(mixed)).drop("_own")
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        predicted = predicted.withColumn("_v", F.element_at(F.array(*[F.lit(c) for c in classes]), best)).withColumn("_p", F.array_max("_p"))
    filled = predicted.withColumn(mark, F.lit(True)).withColumnRenamed("_p", share)
    out = complete.unionByName(filled.select(*complete.columns))
    return out.withColumn(column, F.col("_v")).drop("_v")


def with_groups_of(rows: DataFrame, other: DataFrame, key: Column, subject: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``_{column}`` of the subject's most frequent value in ``other``, the smallest of equals, NULL where there is none.

    A subject's distinct values are counted in one pass; ``key`` is the subject's key in ``rows``.
    """
    named = other.select(subject_key(subject).alias("_subject"), *[F.col(f"`{c}`").cast("string").alias(f"_{c}") for c in columns]).filter("_subject IS NOT NULL")
    best = named.groupBy("_subject").agg(*[F.mode(f"_{c}", True).alias(f"_{c}") for c in columns])
    return rows.join(best, key == F.col("_subject"), "left").drop("_subject")


def filled_cells(tables: Sequence[tuple[str, DataFrame, Sequence[str]]], row_id: str = "row_id") -> DataFrame:
    """(table_name, row_id, column_name) of every marked cell."""
    out = None
    for name, df, columns in tables:
        marks = F.array(*[F.when(F.col(f"{c}_filled"), F.lit(c)) for c in columns])
        part = df.select(F.lit(name).alias("table_name"), F.col(row_id), F.explode(marks).alias("column_name")).filter("column_name IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def hold_out(rows: DataFrame, column: str, usable: Column, hidden: Column, fill: Callable[[DataFrame], DataFrame], row_id: str = "row_id", log: bool = False) -> DataFrame:
    """(column_name, n_hidden, baseline_error, error) when the usable values of ``hidden`` rows are taken out and filled.

    For numbers both errors are root mean squares (of log1p with ``log``), the baseline is the mean of the rest; for texts
    they are shares of wrong classes, the baseline is the most frequent class of the rest.
    """
    # the row id comes along under a name of its own, whatever other columns there are
    marked = rows.withColumn("_truth", usable).withColumn("_hidden", hidden & F.col("_truth").isNotNull())
    kind = rows.schema[column].dataType.simpleString()
    masked = marked.withColumn(column, F.when(~F.col("_hidden"), F.col(f"`{column}`")).otherwise(F.lit(None).cast(kind)))
    done = fill(masked).filter("_hidden").select("_truth", F.col(f"`{column}`").alias("_told"))
    rest = marked.filter("NOT _hidden AND _truth IS NOT NULL")
    if dict(marked.dtypes)["_truth"] == "string":
        naive = rest.groupBy("_truth").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "_truth"))["_truth"].alias("_naive"))
        wrong = lambda c: F.avg((F.col(c) != F.col("_truth")).cast("double"))
    else:
        scale = F.log1p if log else lambda c: c
        done = done.withColumns({c: scale(F.col(c)) for c in ("_truth", "_told")})
        naive = rest.agg(F.avg(scale(F.col("_truth"))).alias("_naive"))
        wrong = lambda c: F.sqrt(F.avg((F.col(c) - F.col("_truth")) * (F.col(c) - F.col("_truth"))))
    # one row, so a literal
    first = naive.first()
    done = done.withColumn("_naive", F.lit(first["_naive"] if first else None))
    return done.agg(F.count(F.lit(1)).alias("n_hidden"), wrong("_naive").alias("baseline_error"), wrong("_told").alias("error")).select(F.lit(column).alias("column_name"), "n_hidden", "baseline_error", "error")
