"""Mixing sources to target shares of the total size by hash thresholds.

Every document has a fixed hash. For a source with a budget, all documents are taken q
times and those whose hash lies below a threshold once more, so the copies are nested: a
larger budget keeps all that a smaller one took. The threshold comes from histograms: sizes are
summed by source and leading hash bits, the bucket in which the budget ends is found, and
only that bucket is summed again by its next bits, until the bits are used up or the
bucket holds one hash. The choice is then a filter; nothing is sorted.

The total is, unless given, the largest at which every source with documents can hold its
share within its repeats. With a larger total a source may fall short; with targets that
have no documents the shares of the rest are those among themselves. Both are named in the report.

Defined cases: sources are compared by letters and digits only; documents with NULL or
unknown source are not chosen and are reported as ``untargeted``; documents without text
weigh nothing and go with their hash; repeated ids are separate documents with one hash, so
they are chosen together; NULL or negative shares and repeats count as 0; targets of one source in several spellings are one target with the sum of
their shares and the least of their repeats, under the first name; an empty table
chooses nothing and every target is named; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.text import id_key

#: Bits of the hash that a level of histograms resolves, and how many levels there are.
LEVEL_BITS = 12
LEVELS = 5
HASH_BITS = LEVEL_BITS * LEVELS
MOST_TARGETS = 1000
SEED = 20240229


@dataclass
class Target:
    source: str
    share: float
    max_repeats: int
    available: int = 0
    n_docs: int = 0
    budget: float = 0.0
    every: int = 0
    threshold: int = 0


def hashed(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """``sizes`` (doc_id, source, n_tokens) with the source's key and a hash of ``HASH_BITS`` bits."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - HASH_BITS)
    return sizes.select("doc_id", id_key(F.col("source")).alias("source_key"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), h.alias("h"))


def read_targets(targets: DataFrame) -> dict[str, Target]:
    """Targets by source key; their number is bounded."""
    rows = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out: dict[str, Target] = {}
    for r in sorted(rows, key=lambda r: r["source"]):
        key = "".join(c for c in r["source"].upper() if c.isalnum())
        one = Target(r["source"], max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0))
        if key in out:
            # the same source in another spelling: its shares add up, and the stricter cap holds
            one = Target(out[key].source, out[key].share + one.share, min(out[key].max_repeats, one.max_repeats))
        out[key] = one
    return out


def plan(docs: DataFrame, targets: dict[str, Target], total_tokens: float | None = None) -> dict[str, Target]:
    """Budgets, full passes and hash thresholds of every target."""
    keys = sorted(targets)
    known = docs.filter(F.col("source_key").isin(keys)) if keys else docs.limit(0)
    for r in known.groupBy("source_key").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        targets[r["source_key"]].available, targets[r["source_key"]].n_docs = int(r["t"]), int(r["n"])
    can = [t for t in targets.values() if t.available and t.share > 0 and t.max_repeats > 0]
    if total_tokens is None:
        total_tokens = min((t.available * t.max_repeats / t.share for t in can), default=0.0)
    for t in targets.values():
        t.budget = min(t.share * total_tokens, float(t.available * t.max_repeats))
        t.every = int(t.budget // t.available) if t.available else 0
        t.threshold = 0
    need = {k: t.budget - t.every * t.available for k, t in targets.items() if t.available and t.every < t.max_repeats}
    need = {k: n for k, n in need.items() if n >= 1}
    start = dict.fromkeys(need, 0)
    for level in range(LEVELS):
        if not need:
            break
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = F.lit(False)
        for k, s in start.items():
            inside = inside | ((F.col("source_key") == k) & (F.col("h") >= s) & (F.col("h") < s + (1 << (shift + LEVEL_BITS))))
        # at most 2**LEVEL_BITS rows for each target come back
        sums = known.filter(inside).groupBy("source_key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count_distinct("h").alias("n") if level == LEVELS - 1 else F.count(F.lit(1)).alias("n")).collect()
        by: dict[str, list] = {k: [] for k in need}
        for r in sums:
            by[r["source_key"]].append((r["bucket"], int(r["t"]), int(r["n"])))
        for k in list(need):
            end = start[k] + (1 << (shift + LEVEL_BITS))
            for bucket, size, n in sorted(by[k]):
                if size <= need[k]:
                    need[k] -= size
                    continue
                start[k] = bucket << shift
                # a bucket of one document ends the search: it is taken if that comes nearer
                if n == 1 or level == LEVELS - 1:
                    targets[k].threshold = (bucket + 1) << shift if size - need[k] < need[k] else bucket << shift
                    del need[k], start[k]
                break
            else:
                targets[k].threshold = end
                del need[k], start[k]
    return targets


def choose(docs: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every document that is chosen."""
    plans = docs.sparkSession.createDataFrame([(k, t.source, t.every, t.threshold) for k, t in targets.items()], "source_key string, source string, every int, threshold long")
    # at most MOST_TARGETS rows, so broadcasting them is safe
    known = docs.join(F.broadcast(plans), "source_key")
    repeats = F.col("every") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return known.select("doc_id", "source", F.col("n_tokens").cast("int").alias("n_tokens"), repeats.cast("int").alias("repeats")).filter("repeats > 0")


def report(docs: DataFrame, targets: dict[str, Target], tolerance: float = 0.005) -> DataFrame:
    """Per target its actual share and status, and one row for what has no target.

    status: met, too few tokens, no documents, or untargeted. A share is met if it is
    within ``tolerance`` of the target's share among the targets that have documents.
    """
    spark = docs.sparkSession
    chosen = choose(docs, targets)
    per = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_chosen"), F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    listed = spark.createDataFrame(
        [(t.source, t.share, t.max_repeats, t.n_docs, t.available) for t in targets.values()],
        "source string, target_share double, max_repeats int, n_docs long, available_tokens long",
    )
    joined = listed.join(F.broadcast(per), "source", "left").fillna(0, ["n_chosen", "tokens", "most_repeats"])
    # one row per target: a bounded number
    total = sum(r["tokens"] for r in joined.select("tokens").collect())
    feasible = sum(t.share for t in targets.values() if t.available)
    actual = F.col("tokens") / F.lit(float(total or 1))
    status = (
        F.when(F.col("available_tokens") == 0, "no documents")
        .when(F.abs(actual - F.col("target_share") / F.lit(feasible or 1.0)) <= tolerance, "met")
        .otherwise("too few tokens")
    )
    other = docs.filter(F.col("source_key").isNull() | ~F.col("source_key").isin(list(targets))).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("available_tokens"))
    untargeted = other.select(
        F.lit("(untargeted)").alias("source"), F.lit(0.0).alias("target_share"), F.lit(0.0).alias("actual_share"), F.lit(0).alias("max_repeats"), F.lit(0).alias("most_repeats"),
        "n_docs", F.lit(0).cast("long").alias("n_chosen"), "available_tokens", F.lit(0).cast("long").alias("tokens"), F.lit("untargeted").alias("status"),
    )
    return joined.select("source", "target_share", F.round(actual, 6).alias("actual_share"), "max_repeats", "most_repeats", "n_docs", "n_chosen", "available_tokens", "tokens", status.alias("status")).unionByName(untargeted)
