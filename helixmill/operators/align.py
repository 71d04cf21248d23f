"""Matching samples across modalities: common ids, patients, barcodes, mappings, overlaps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.errors import SampleAlignmentError
from helixmill.functions import ids


def keys_of(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(modality, id): the distinct ids of every table that has the key."""
    parts = [t.filter(F.col(key).isNotNull()).select(F.lit(n).alias("modality"), F.col(key).cast("string").alias("id")).distinct() for n, t in tables.items() if key in t.columns]
    if not parts:
        raise SampleAlignmentError(f"no table has {key}")
    return reduce(DataFrame.unionByName, parts)


def common_ids(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Ids that every table with rows and the key has: one count per id instead of a chain of intersections."""
    keys = keys_of(tables, key)
    filled = keys.select("modality").distinct().count()
    return keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == filled).select("id")


def align(tables: Mapping[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every table cut down to the common ids."""
    common = common_ids(tables, key).withColumnRenamed("id", "_common_id")
    return {n: t.join(common, t[key].cast("string") == F.col("_common_id"), "left_semi") if key in t.columns else t for n, t in tables.items()}


def align_by_patient(tables: Mapping[str, DataFrame], columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """As ``align`` on the patient that each table's own id column names; adds ``patient_key``."""
    keyed = {n: t.withColumn("patient_key", ids.patient_id(F.col(f"`{columns.get(n) or ids.sample_column(t)}`"))) for n, t in tables.items()}
    return align(keyed, "patient_key")


def match_by(tables: Mapping[str, DataFrame], columns: Mapping[str, str], key: Column | str = "patient", fuzzy: bool = False) -> DataFrame:
    """(id) of the patients or barcodes that all tables share."""
    def derive(c: Column) -> Column:
        if key == "patient":
            return ids.patient_id(c)
        return F.coalesce(ids.barcode(c), c) if fuzzy else ids.barcode(c)

    return common_ids({n: t.select(derive(F.col(f"`{columns[n]}`")).alias("id_")) for n, t in tables.items()}, "id_")


def match_by_time(tables: Mapping[str, DataFrame], key: str, time: str) -> DataFrame:
    """Ids that have a time in every table."""
    return common_ids({n: t.filter(F.col(time).isNotNull()) for n, t in tables.items()}, key)


def overlap(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(a, b, n_common, jaccard) of every pair of modalities; with themselves the size."""
    keys = keys_of(tables, key)
    # an id has at most one row per modality, so its pairs are few
    per = keys.groupBy("id").agg(F.collect_list("modality").alias("m"))
    pairs = per.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"))
    sizes = pairs.filter("a = b").select(F.col("a").alias("k"), F.col("n_common").alias("size"))
    out = pairs.join(sizes.withColumnsRenamed({"k": "a", "size": "size_a"}), "a").join(sizes.withColumnsRenamed({"k": "b", "size": "size_b"}), "b")
    jaccard = F.col("n_common") / (F.col("size_a") + F.col("size_b") - F.col("n_common"))
    return out.select("a", "b", "n_common", F.when(F.col("a") == F.col("b"), F.col("n_common").cast("double")).otherwise(jaccard).alias("jaccard"))


def alignment_stats(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(modality, n_samples, n_matched, matched_percent, n_missing) per modality."""
    keys = keys_of(tables, key)
    common = common_ids(tables, key).withColumn("hit", F.lit(1))
    hit = F.count("hit")
    n = F.count(F.lit(1))
    return keys.join(common, "id", "left").groupBy("modality").agg(n.alias("n_samples"), hit.alias("n_matched"), (hit * 100.0 / n).alias("matched_percent"), (n - hit).alias("n_missing"))


def consistency(tables: Mapping[str, DataFrame], key: str, order: str | None = None) -> DataFrame:
    """(modality, n_rows, same_length, same_ids) against the first modality; with ``order`` also same_order."""
    first = next(iter(tables))
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("modality"), F.col(key).cast("string").alias("id"), *([F.col(order).alias("pos")] if order else [])) for n, t in tables.items()])
    n = rows.groupBy("modality").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    base = rows.filter(F.col("modality") == first)
    shared = rows.select("modality", "id").distinct().join(base.select("id").distinct(), "id", "left_semi").groupBy("modality").agg(F.count(F.lit(1)).alias("n_shared"))
    mine = n.filter(F.col("modality") == first).select(F.col("n_rows").alias("base_rows"), F.col("n_ids").alias("base_ids"), F.lit(1).alias("_one"))
    out = n.join(shared, "modality", "left").withColumn("_one", F.lit(1)).join(mine, "_one")
    out = out.select("modality", "n_rows", (F.col("n_rows") == F.col("base_rows")).alias("same_length"), ((F.col("n_ids") == F.col("base_ids")) & (F.coalesce("n_shared", F.lit(0)) == F.col("base_ids"))).alias("same_ids"))
    if order:
        moved = rows.join(base.select("pos", F.col("id").alias("base_id")), "pos").groupBy("modality").agg((F.count_if(F.col("id") != F.col("base_id")) == 0).alias("same_order"))
        out = out.join(moved, "modality", "left")
    return out


def validate_mapping(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(id_a, id_b, how): one-to-one matches, first exact, then by letter case, then without dashes and underscores."""
    left = a.filter(F.col(key_a).isNotNull()).select(F.col(key_a).cast("string").alias("id_a")).distinct()
    right = b.filter(F.col(key_b).isNotNull()).select(F.col(key_b).cast("string").alias("id_b")).distinct()
    exact = left.join(right, left["id_a"] == right["id_b"]).select("id_a", "id_b", F.lit("exact").alias("how"))
    out = exact
    for how, form in (("case", F.lower), ("punctuation", lambda c: F.translate(c, "-_", ""))):
        rest_a, rest_b = left.join(out, "id_a", "left_anti"), right.join(out, "id_b", "left_anti")
        # of several ids with one form the n-th meets the n-th, so nobody is matched twice
        na = rest_a.withColumn("k", form(F.col("id_a"))).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id_a")))
        nb = rest_b.withColumn("k", form(F.col("id_b"))).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id_b")))
        out = out.unionByName(na.join(nb, ["k", "r"]).select("id_a", "id_b", F.lit(how).alias("how")))
    return out


def mapping_score(matches: DataFrame, a: DataFrame, b: DataFrame, key_a: str, key_b: str, least: float = 0.8) -> DataFrame:
    """One row: matched ids, their share of the longer list, and whether that is enough."""
    size = lambda t, k: t.filter(F.col(k).isNotNull()).agg(F.count_distinct(F.col(k).cast("string")).alias("n")).withColumn("_one", F.lit(1))
    n = size(a, key_a).withColumnRenamed("n", "na").join(size(b, key_b).withColumnRenamed("n", "nb"), "_one")
    share = F.try_divide(F.col("n_matched"), F.greatest("na", "nb"))
    return matches.agg(F.count(F.lit(1)).alias("n_matched")).withColumn("_one", F.lit(1)).join(n, "_one").select("n_matched", share.alias("share"), F.coalesce(share >= least, F.lit(False)).alias("valid"))
