"""Filling containers of fixed capacity with items by best-two-fit.

A container is filled greedily with the largest item that fits. Then its smallest item is
taken out and, of all pairs of unpacked items that fit the expanded gap, the pair that
fills it most tightly goes in, if it fills more than the item did.

Only items larger than the capacity are split: into full pieces, each a container of its
own, and one remainder that is packed like any other item. Remainders and whole items are spread by
hash over shards of about ``SHARD_ITEMS`` items, each packed by one task in memory that the
shard bounds; a shard leaves at most one container badly filled.

Defined cases: NULL and empty texts (and NULL sizes) have no tokens and join a container of their shard
without using space; equal sizes are taken in the order of their ids; repeated ids are
separate items; a NULL or non-positive capacity makes no containers; more than ``MOST_PLANS`` plans are refused; an empty table
packs to nothing; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a task packs at once.
SHARD_ITEMS = 20_000
MOST_PLANS = 1000
SCHEMA = "plan_id string, container_id string, position int, doc_id long, piece int, token_start long, token_end long, n_tokens int, unused_tokens int"


def best_two_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` by container; every size is from 1 to ``capacity``."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        waiting[sizes[i]].append(i)
    count = np.array([len(w) for w in waiting], dtype=np.int64)
    index = np.arange(capacity + 1)
    # the largest waiting size up to x; what is taken out only lowers it, so it is mended on the way
    below = np.maximum.accumulate(np.where(count > 0, index, 0))

    def largest(x: int) -> int:
        trail = []
        while (y := int(below[x])) and not count[y]:
            trail.append(x)
            x = y - 1
        for t in trail:
            below[t] = y
        return y

    def take(size: int) -> int:
        count[size] -= 1
        return waiting[size].pop()

    left, out = len(sizes), []
    while left:
        gap, held = capacity, []
        while gap and (s := largest(gap)):
            held.append(take(s))
            gap -= s
            left -= 1
        if gap and left >= 2:
            small = sizes[held[-1]]
            room = gap + small
            have = np.flatnonzero(count[:room])
            if have.size:
                last = np.maximum.accumulate(np.where(count[: room + 1] > 0, index[: room + 1], 0))
                partner = last[np.minimum(room - have, have)]
                single = (partner == have) & (count[have] < 2)
                partner[single] = last[have[single] - 1]
                total = np.where(partner > 0, have + partner, 0)
                best = int(total.argmax())
                if total[best] > small:
                    a, b = int(have[best]), int(partner[best])
                    back = held.pop()
                    held += [take(a), take(b)]
                    left -= 1
                    waiting[small].append(back)
                    count[small] += 1
                    np.maximum(below[small:], small, out=below[small:])
        out.append(held)
    return out


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    plan, shard = key
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    full = pdf["n_tokens"].to_numpy()
    items = np.flatnonzero(full > 0)
    bins = [[int(items[i]) for i in b] for b in best_two_fit(full[items].tolist(), capacity)]
    empty = np.flatnonzero(full == 0).tolist()
    if empty:
        bins = bins or [[]]
        bins[-1] = bins[-1] + empty
    order = np.array([i for b in bins for i in b], dtype=np.int64)
    lengths = np.array([len(b) for b in bins], dtype=np.int64)
    number = np.repeat(np.arange(len(bins)), lengths)
    position = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = np.bincount(number, weights=full[order], minlength=len(bins)).astype(np.int64)
    picked = pdf.iloc[order]
    return pd.DataFrame({
        "plan_id": plan,
        "container_id": [f"{plan}:{shard}:{n}" for n in number],
        "position": position.astype("int32"),
        "doc_id": picked["doc_id"].to_numpy(),
        "piece": picked["piece"].to_numpy().astype("int32"),
        "token_start": picked["token_start"].to_numpy(),
        "token_end": picked["token_start"].to_numpy() + picked["n_tokens"].to_numpy(),
        "n_tokens": picked["n_tokens"].to_numpy().astype("int32"),
        "unused_tokens": (capacity - used[number]).astype("int32"),
    })


def pack(sizes: DataFrame, plans: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``sizes`` (doc_id, n_tokens) packed for each of ``plans`` (plan_id, capacity_tokens)."""
    fixed = [(r[0], r[1]) for r in plans.select("plan_id", "capacity_tokens").filter("plan_id IS NOT NULL AND capacity_tokens > 0").distinct().limit(MOST_PLANS + 1).collect()]
    if len(fixed) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    n = sizes.count()
    if not fixed or not n:
        return sizes.sparkSession.createDataFrame([], SCHEMA)
    shards = -(-n // shard_items)
    offers = F.array(*[F.struct(F.lit(p).alias("plan_id"), F.lit(int(c)).alias("capacity")) for p, c in sorted(fixed)])
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    offered = sizes.select("doc_id", "n_tokens", F.explode(offers).alias("o")).select("doc_id", "n_tokens", "o.plan_id", "o.capacity")
    offered = offered.withColumn("whole", F.when(F.col("n_tokens") == F.col("capacity"), F.lit(1)).otherwise(whole))
    piece = F.col("piece").cast("long") * F.col("capacity")
    alone = offered.filter("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(
        "plan_id",
        F.concat_ws(":", "plan_id", F.lit("whole"), F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.monotonically_increasing_id().cast("string")).alias("container_id"),
        F.lit(0).alias("position"), "doc_id", "piece", piece.alias("token_start"), (piece + F.col("capacity")).alias("token_end"),
        F.col("capacity").alias("n_tokens"), F.lit(0).alias("unused_tokens"),
    )
    rest = offered.select(
        "plan_id", "capacity", "doc_id", F.col("whole").alias("piece"), (F.col("whole").cast("long") * F.col("capacity")).alias("token_start"),
        (F.col("n_tokens") - F.col("whole") * F.col("capacity")).alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    ).filter("n_tokens > 0 OR piece = 0")
    packed = rest.groupBy("plan_id", "shard").applyInPandas(_pack, SCHEMA)
    return alone.unionByName(packed)


def summary(packed: DataFrame) -> DataFrame:
    """Per plan: containers, tokens held, unused tokens and the share of space that is used."""
    per = packed.groupBy("plan_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.max("unused_tokens").alias("u"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.sum("u").alias("unused_tokens"),
        F.round(F.sum("t") / F.sum(F.col("t") + F.col("u")), 6).alias("used_share"),
    )


def audit(packed: DataFrame, sizes: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: documents, and those missing, with tokens lost or placed twice, or split although they fit; containers that are too full or whose unused space is wrong."""
    capacity = plans.filter("plan_id IS NOT NULL AND capacity_tokens > 0").groupBy("plan_id").agg(F.max("capacity_tokens").alias("capacity"))
    held = packed.groupBy("plan_id", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("spans"), F.max("token_end").alias("last"), F.countDistinct("token_start").alias("starts"))
    want = sizes.groupBy("doc_id").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("want"), F.max(F.coalesce("n_tokens", F.lit(0))).alias("largest"), F.count(F.lit(1)).alias("copies"))
    offers = F.array(*[F.struct(F.lit(r["plan_id"]).alias("plan_id"), F.lit(r["capacity"]).alias("capacity")) for r in capacity.limit(MOST_PLANS).collect()]).cast("array<struct<plan_id:string,capacity:int>>")
    wanted = want.select("*", F.explode(offers).alias("o")).select("doc_id", "want", "largest", "copies", "o.*").alias("w")
    # documents without an id count as one
    same = (F.col("w.plan_id") == F.col("h.plan_id")) & F.col("w.doc_id").eqNullSafe(F.col("h.doc_id"))
    both = wanted.join(held.alias("h"), same, "left").select("w.*", "held", "pieces", "spans", "last", "starts")
    docs = both.groupBy("plan_id").agg(
        F.sum("copies").alias("n_docs"), F.count_if(F.col("held").isNull()).alias("n_missing"),
        F.count_if((F.col("held") != F.col("want")) | (F.col("spans") != F.col("want")) | (F.col("last") != F.col("largest")) | ((F.col("copies") == 1) & (F.col("starts") != F.col("pieces")))).alias("n_wrong_tokens"),
        F.count_if((F.col("largest") <= F.col("capacity")) & (F.col("pieces") > F.col("copies"))).alias("n_split_in_vain"))
    bins = packed.groupBy("plan_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.min("unused_tokens").alias("low"), F.max("unused_tokens").alias("high")).join(capacity, "plan_id")
    wrong = (F.col("t") > F.col("capacity")) | (F.col("low") != F.col("high")) | (F.col("t") + F.col("low") != F.col("capacity"))
    return docs.join(bins.groupBy("plan_id").agg(F.count_if(wrong).alias("n_wrong_containers")), "plan_id", "left")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
