"""References to records that do not exist when the referring row is loaded.

The check runs on distinct (key, loaded_at) pairs: however often a key is repeated, and
however much one key dominates, it meets the parents once. Parents are reduced to what
can decide: the first arrival of a key that was never withdrawn, and the distinct
lifetimes of the rest. The rows themselves are only joined back to pairs found orphaned, in a join whose
partitions the engine splits where one key holds a large part of the rows.

Defined cases: NULL and blank references are no references and never orphans; text made
only of punctuation is a reference to nothing; a parent row with NULL loaded_at is never
visible; a row with NULL loaded_at sees no parents, so its reference is an orphan; an empty
parent table orphans every reference.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.text import id_key, is_blank

@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent.parent_column``."""

    table_name: str
    child: DataFrame
    column: str
    parent: DataFrame
    parent_column: str
    row_id: str = "row_id"
    loaded_at: str = "loaded_at"
    parent_loaded_at: str = "loaded_at"
    parent_retracted_at: str = "retracted_at"


def lifetimes(parent: DataFrame, column: str, loaded_at: str, retracted_at: str) -> DataFrame:
    """(key, begins, ends): when a key is visible; ``ends`` is NULL where it never stops."""
    keyed = parent.filter(~is_blank(F.col(f"`{column}`")) & F.col(f"`{loaded_at}`").isNotNull()).select(
        id_key(F.col(f"`{column}`")).alias("key"), F.col(f"`{loaded_at}`").alias("begins"), F.col(f"`{retracted_at}`").alias("ends")
    )
    return keyed.filter("key != ''").groupBy("key", "ends").agg(F.min("begins").alias("begins"))


def orphan_pairs(ref: Reference) -> DataFrame:
    """The distinct (key, seen) pairs of ``ref`` that meet no visible parent."""
    col, at = F.col(f"`{ref.column}`"), F.col(f"`{ref.loaded_at}`")
    pairs = ref.child.filter(~is_blank(col)).select(id_key(col).alias("key"), at.alias("seen")).distinct()
    alive = lifetimes(ref.parent, ref.parent_column, ref.parent_loaded_at, ref.parent_retracted_at)
    on = (F.col("c.key") == F.col("p.key")) & (F.col("p.begins") <= F.col("c.seen")) & (F.col("p.ends").isNull() | (F.col("p.ends") > F.col("c.seen")))
    return pairs.alias("c").join(alive.alias("p"), on, "left_anti")


def orphan_rows(refs: Sequence[Reference]) -> DataFrame:
    """(table_name, row_id, column_name, reference, loaded_at) of every orphan row."""
    out = None
    for ref in refs:
        col, at = F.col(f"`{ref.column}`"), F.col(f"`{ref.loaded_at}`")
        rows = ref.child.filter(~is_blank(col)).select(
            F.lit(ref.table_name).alias("table_name"), F.col(f"`{ref.row_id}`").alias("row_id"), F.lit(ref.column).alias("column_name"),
            col.alias("reference"), at.alias("loaded_at"), id_key(col).alias("key"),
        )
        same = (F.col("r.key") == F.col("o.key")) & F.col("r.loaded_at").eqNullSafe(F.col("o.seen"))
        part = rows.alias("r").join(orphan_pairs(ref).alias("o"), same, "left_semi").drop("key")
        out = part if out is None else out.unionByName(part)
    return out


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """Orphans per table and month of loaded_at, beside all references of that month."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    orphans = orphan_rows(refs).groupBy("table_name", "column_name", month).agg(F.count(F.lit(1)).alias("n_orphans"))
    total = None
    for ref in refs:
        part = ref.child.filter(~is_blank(F.col(f"`{ref.column}`"))).groupBy(
            F.lit(ref.table_name).alias("table_name"), F.lit(ref.column).alias("column_name"), F.date_format(F.col(f"`{ref.loaded_at}`"), "yyyy-MM").alias("month")
        ).agg(F.count(F.lit(1)).alias("n_references"))
        total = part if total is None else total.unionByName(part)
    on = (F.col("t.table_name") == F.col("o.table_name")) & (F.col("t.column_name") == F.col("o.column_name")) & F.col("t.month").eqNullSafe(F.col("o.month"))
    return total.alias("t").join(orphans.alias("o"), on, "left").select("t.table_name", "t.column_name", "t.month", "n_references", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))
