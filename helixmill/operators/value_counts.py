"""Column profiles from maintained value counts.

A store is a folder of signed deltas (table_name, column_name, load_id, value, text, cnt): how often
each value occurs in a column of a load, as a number or, for columns of other types, as text. NULL and NaN are
neither. ``maintain`` keeps such a folder up to date: it adds the counts of loads that are new, takes back
those of loads that are gone, and both for loads that have changed, each as rows with a sign.
Profiles are made from the summed deltas alone and never need the rows again.

A ledger beside the deltas says which state of a load they stand for (its rows and a checksum over
row hashes). Both are written as one version each; a version without a ledger is ignored, so an update that
was broken off leaves no trace in the sums.

Defined cases: a column with no rows in a load has no profile row; a load with only missing
values has NULL range, quantiles and entropy; infinite numbers are values and are invalid
where the range has an end on their side; repeated rows count as often as they occur; rows without a load
belong to the load NULL; an empty table gives an empty store, and takes back what an earlier state had. Columns other than those named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.errors import ValidationError
from helixmill.functions.text import clean_number

KEYS = ["table_name", "column_name", "load_id"]
#: Order-preserving buckets per doubling of the absolute value, for distributed quantiles.
BUCKETS_PER_OCTAVE = 4096
STORE = "table_name string, column_name string, load_id int, value double, text string, cnt long, version string"
LEDGER = "table_name string, load_id int, columns string, n_rows long, checksum decimal(38,0), step int, version string"
#: Loads of all tables of a store that a ledger may name.
MOST_LOADS = 1_000_000


def delta(rows: DataFrame, table_name: str, columns: Sequence[str], load: str = "load_id", sign: int = 1) -> DataFrame:
    """The signed value counts of ``rows``: one shuffle, with counts combined before it."""
    def pair(c: str) -> Column:
        if isinstance(rows.schema[c].dataType, T.NumericType):
            number, text = clean_number(F.col(f"`{c}`")) + F.lit(0.0), F.lit(None).cast("string")
        else:
            number, text = F.lit(None).cast("double"), F.col(f"`{c}`").cast("string")
        return F.struct(F.lit(c).alias("column_name"), number.alias("value"), text.alias("text"))

    long = rows.select(F.col(f"`{load}`").cast("int").alias("load_id"), F.explode(F.array(*[pair(c) for c in columns])).alias("p"))
    return (
        long.select(F.lit(table_name).alias("table_name"), "p.column_name", "load_id", "p.value", "p.text")
        .groupBy(*KEYS, "value", "text")
        .agg((F.count(F.lit(1)) * sign).alias("cnt"))
    )


def apply_deltas(store: DataFrame | None, deltas: Sequence[DataFrame]) -> DataFrame:
    """The store after the deltas; values whose count has come to nothing are gone."""
    total = reduce(DataFrame.unionByName, ([store] if store is not None else []) + list(deltas))
    return total.groupBy(*KEYS, "value", "text").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") != 0)


def observe(rows: DataFrame, table_name: str, columns: Sequence[str], load: str = "load_id") -> DataFrame:
    """(table_name, load_id, columns, n_rows, checksum): the state of each load; one pass, a few numbers per load."""
    state = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).alias("checksum")
    return rows.groupBy(F.col(f"`{load}`").cast("int").alias("load_id")).agg(F.count(F.lit(1)).alias("n_rows"), state).select(
        F.lit(table_name).alias("table_name"), "load_id", F.lit(",".join(columns)).alias("columns"), "n_rows", "checksum")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The summed deltas of the store at ``path``, of versions that have a ledger."""
    known = _ledger(spark, path)
    if known is None:
        return None
    done = [r["version"] for r in known.select("version").distinct().collect()]
    return apply_deltas(spark.read.schema(STORE).parquet(f"{path}/deltas").filter(F.col("version").isin(done)).drop("version"), [])


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if _exists(spark, f"{path}/ledger/_SUCCESS") else None


def maintain(spark: SparkSession, path: str, sources: Mapping[str, tuple[DataFrame, Sequence[str]]], load: str = "load_id") -> DataFrame:
    """Bring the store at ``path`` up to date with ``sources`` (rows and columns by table) and return its sums.

    Only loads whose state differs from the ledger are counted; a load that changed or went away is first taken
    back by the negative of its stored counts. A store has one writer at a time.
    """
    seen = reduce(DataFrame.unionByName, [observe(rows, name, columns, load) for name, (rows, columns) in sources.items()]).limit(MOST_LOADS + 1).collect()
    if len(seen) > MOST_LOADS:
        raise ValidationError(f"more than {MOST_LOADS} loads")
    ledger, latest = _ledger(spark, path), {}
    for r in sorted(ledger.collect() if ledger is not None else [], key=lambda r: r["step"]):
        latest[r["table_name"], r["load_id"]] = (r["columns"], r["n_rows"], r["checksum"])
    step = 1 + ((ledger.agg(F.max("step")).first()[0] or 0) if ledger is not None else 0)
    version = uuid.uuid4().hex
    now = {(r["table_name"], r["load_id"]): (r["columns"], r["n_rows"], r["checksum"]) for r in seen}
    now |= {k: (v[0], 0, None) for k, v in latest.items() if k not in now and k[0] in sources}
    changed = {k: v for k, v in now.items() if latest.get(k) != v}
    if changed:
        marks = spark.createDataFrame([(t, n) for t, n in changed], "table_name string, load_id int")
        deltas = []
        if any(k in latest for k in changed):
            stored = read_store(spark, path)
            # at most MOST_LOADS rows of two values, checked above
            taken = stored.alias("s").join(F.broadcast(marks).alias("m"), (F.col("s.table_name") == F.col("m.table_name")) & F.col("s.load_id").eqNullSafe(F.col("m.load_id")), "left_semi")
            deltas.append(taken.withColumn("cnt", -F.col("cnt")))
        for name, (rows, columns) in sources.items():
            loads = [n for t, n in changed if t == name]
            if len(loads) == len([1 for t, _ in now if t == name]):
                deltas.append(delta(rows, name, columns, load))
            elif loads:
                deltas.append(delta(rows.filter(F.col(f"`{load}`").cast("int").isin([n for n in loads if n is not None]) | (F.col(f"`{load}`").isNull() if None in loads else F.lit(False))), name, columns, load))
        signed = reduce(DataFrame.unionByName, deltas).withColumn("version", F.lit(version))
        signed.select(*[f.strip().split(" ")[0] for f in STORE.split(",")]).write.mode("append").parquet(f"{path}/deltas")
        entries = [(t, n, *v, step, version) for (t, n), v in changed.items()]
        spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    out = read_store(spark, path)
    return out if out is not None else spark.createDataFrame([], STORE).drop("version")


def _valid(value: Column, ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    ok: Column = F.lit(True)
    for column, (low, high) in ranges.items():
        inside: Column = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        ok = F.when(F.col("column_name") == column, inside).otherwise(ok)
    return ok


def _bucket(value: Column) -> Column:
    """A long that grows with ``value``: the position of its logarithm, mirrored for negatives."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * BUCKETS_PER_OCTAVE) + F.lit(5_000_000)
    size = F.when(F.abs(value) == float("inf"), F.lit(50_000_000)).otherwise(size)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def quantiles(counts: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles of (value, cnt) rows per key, without a task that sees a whole group.

    Sums per bucket find the buckets that hold the wanted ranks; only the values of those
    buckets are then ordered, each bucket by itself.
    """
    counts = counts.filter(F.col("value").isNotNull()).withColumn("_b", _bucket(F.col("value")))
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_n"))
    w = Window.partitionBy(*keys)
    placed = by_bucket.select(
        *keys, "_b", "_n",
        F.sum("_n").over(w).alias("_total"),
        (F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.lit(p).alias("p"), (F.floor if side == "lo" else F.ceil)(F.lit(p) * (F.col("_total") - 1)).alias("rank"))
        for name, p in probabilities.items()
        for side in ("lo", "hi")
    ])
    wanted = placed.withColumn("_r", F.explode(ranks)).filter((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_n")))
    buckets = wanted.groupBy(*keys, "_b").agg(F.first("_before").alias("_before"), F.first("_total").alias("_total"), F.collect_list("_r").alias("_rs"))
    inner = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_b"]])
    inside = counts.alias("c").join(buckets.alias("b"), same).select(*[f"c.{k}" for k in [*keys, "_b"]], "c.value", "c.cnt", "b._before", "b._total", "b._rs")
    found = (
        inside.withColumn("_upto", F.sum("cnt").over(inner) + F.col("_before"))
        .withColumn("_r", F.explode("_rs"))
        .filter((F.col("_r.rank") < F.col("_upto")) & (F.col("_r.rank") >= F.col("_upto") - F.col("cnt")))
    )
    out = []
    for name, p in probabilities.items():
        at = lambda side: F.max(F.when((F.col("_r.name") == name) & (F.col("_r.side") == side), F.col("value")))  # noqa: E731, B023
        position = F.lit(p) * (F.max("_total") - 1)
        step = F.when(at("hi") == at("lo"), F.lit(0.0)).otherwise((at("hi") - at("lo")) * (position - F.floor(position)))
        out.append((at("lo") + step).alias(name))
    return found.groupBy(*keys).agg(*out)


def value_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts`` with ``before``, how many of the key's rows hold a smaller value.

    The average rank of a value is before + (cnt + 1) / 2. Values are ordered within
    buckets only; a running sum over the buckets places each bucket.
    """
    counts = counts.filter(F.col("value").isNotNull()).withColumn("_b", _bucket(F.col("value")))
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    starts = by_bucket.select(*keys, "_b", (F.sum("_n").over(running) - F.col("_n")).alias("_start"))
    inner = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(starts, [*keys, "_b"]).withColumn("before", F.col("_start") + F.sum("cnt").over(inner) - F.col("cnt")).drop("_b", "_start")


def profile(store: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row per table, column and load, from the counts alone.

    A number outside its column's range, or a text that does not match its column's pattern, is invalid.
    """
    value, text, cnt = F.col("value"), F.col("text"), F.col("cnt")
    there = value.isNotNull() | text.isNotNull()
    fits: Column = _valid(value, ranges)
    for column, pattern in (patterns or {}).items():
        fits = F.when((F.col("column_name") == column) & text.isNotNull(), text.rlike(pattern)).otherwise(fits)
    marked = store.withColumn("_ok", there & F.coalesce(fits, F.lit(True)))
    present = F.when(there, cnt)
    sums = marked.groupBy(*KEYS).agg(
        F.sum("cnt").alias("n_rows"),
        F.coalesce(F.sum(F.when(~there, cnt)), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(there & ~F.col("_ok"), cnt)), F.lit(0)).alias("n_invalid"),
        F.count(present).alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min("text").alias("min_text"),
        F.max("text").alias("max_text"),
        F.coalesce(F.max(present), F.lit(0)).alias("n_most_frequent"),
        F.sum(present * F.log2(present.cast("double"))).alias("_clog"),
        F.sum(present).alias("_present"),
    )
    quarts = quantiles(marked.filter("_ok AND value IS NOT NULL").select(*KEYS, "value", "cnt"), KEYS, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in KEYS])
    joined = sums.alias("s").join(quarts.alias("q"), same, "left")
    share = lambda c: F.col(c) / F.col("n_rows")
    return joined.select(
        *[F.col(f"s.{k}") for k in KEYS],
        "n_rows",
        share("n_missing").alias("missing_share"),
        share("n_invalid").alias("invalid_share"),
        "n_distinct", "min_value", "max_value", "min_text", "max_text",
        share("n_most_frequent").alias("top_share"),
        "median",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.log2(F.col("_present").cast("double")) - F.col("_clog") / F.col("_present")).alias("entropy_bits"),
    )


def shifts(store: DataFrame) -> DataFrame:
    """(table_name, column_name, load_id, shift): total variation distance between a load's values and those of all loads.

    Values that a load does not have add what they weigh among all loads, so only values it has are looked at.
    """
    column = ["table_name", "column_name"]
    known = store.filter("value IS NOT NULL OR text IS NOT NULL")
    every = known.groupBy(*column, "value", "text").agg(F.sum("cnt").alias("_all"))
    of_column = known.groupBy(*column).agg(F.sum("cnt").alias("_n_all"))
    of_load = known.groupBy(*KEYS).agg(F.sum("cnt").alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*column, "value", "text"]])
    both = known.alias("k").join(every.alias("e"), on).select(*[F.col(f"k.{c}") for c in KEYS], "k.cnt", "e._all")
    both = both.join(of_column, column)
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"l.{c}")) for c in KEYS])
    both = both.alias("b").join(of_load.alias("l"), same).select(*[F.col(f"b.{c}") for c in KEYS], (F.col("cnt") / F.col("_n")).alias("p"), (F.col("_all") / F.col("_n_all")).alias("q"))
    return both.groupBy(*KEYS).agg(((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("shift"))


#: Largest difference from the median load, and largest factor, that is still no change.
SHARE_LIMITS = {"missing_share": 0.15, "invalid_share": 0.15, "top_share": 0.20}
FACTOR_LIMITS = {"median": 1.5, "iqr": 2.0}


def compare_loads(profiles: DataFrame, share_limits: Mapping[str, float] = SHARE_LIMITS, factor_limits: Mapping[str, float] = FACTOR_LIMITS) -> DataFrame:
    """Each profile beside the median of its column over all loads, with ``differs``.

    One row per load enters here, so the exact median over loads is cheap. A load whose
    metric, or whose usual metric, is NULL does not differ in it; a usual value of 0 is
    exceeded by any other.
    """
    column = ["table_name", "column_name"]
    usual = profiles.groupBy(*column).agg(*[F.median(m).alias(f"usual_{m}") for m in [*share_limits, *factor_limits]])
    joined = profiles.join(usual, column)
    differs: Column = F.lit(False)
    for metric, limit in share_limits.items():
        differs = differs | F.coalesce(F.abs(F.col(metric) - F.col(f"usual_{metric}")) > limit, F.lit(False))
    for metric, limit in factor_limits.items():
        here, there = F.col(metric), F.col(f"usual_{metric}")
        off = (F.abs(here) > F.abs(there) * limit) | (F.abs(here) * limit < F.abs(there)) | (F.signum(here) * F.signum(there) < 0)
        differs = differs | F.coalesce(off, F.lit(False))
    return joined.withColumn("differs", differs)
