"""Fuzzy matching of ids by the Ratcliff-Obershelp ratio, without comparing all pairs.

Two strings of ratio t or more share a number of letter pairs that follows from their
lengths. So only the rarest pairs of a string, as many as make one of them shared for
certain, are joined on; what meets is verified with the exact ratio in Arrow batches.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import durable


def ratio(a: Column, b: Column) -> Column:
    """Similarity of ``a`` to ``b``; the order of the arguments matters."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y)], dtype="float64")

    return of(a, b)


def _pairs_of(text: Column) -> Column:
    """The letter pairs of a text, each numbered by its occurrence so that repeated ones differ."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def _signatures(strings: DataFrame, column: str, tolerance: float, frequency: DataFrame) -> DataFrame:
    """(column, gram): the rarest pairs of each string, enough for one to be shared with any match.

    A match of ratio t with lengths a and b has t(a+b)/2 matched letters in at most
    (1-t)(a+b)+1 runs, so at least (a+b)(1.5t-1)-1 shared pairs; b is at least a*t/(2-t).
    """
    t = tolerance
    n = F.length(column)
    shared = F.ceil((n + n * t / (2 - t)) * (1.5 * t - 1) - 1 - 1e-9)
    grams = strings.filter(n >= 2).select(column, F.explode(_pairs_of(F.col(column))).alias("gram"), F.greatest(n - 1 - F.greatest(shared, F.lit(1)) + 1, F.lit(1)).alias("take"))
    w = Window.partitionBy(column).orderBy("df", "gram")
    return grams.join(frequency, "gram").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("take")).select(column, "gram")


def _letter_keys(text: Column, t: float) -> Column:
    """Keys of which two strings of ratio ``t`` share one: up to three of their letters together.

    A match with lengths a and b shares o = ceil(t(a+b)/2) letters or more, counted with repetitions. In any fixed order of
    letters, the first k that both have are among the first a-o+k of the one and b-o+k of the other; so all
    combinations of k = min(3, o) of these are keys. b lies between a*t/(2-t) and a*(2-t)/t.
    """
    split = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    numbered = F.transform(split, lambda g, i: F.concat(g, F.size(F.filter(F.slice(split, 1, i + 1), lambda x: x == g)).cast("string")))
    ordered = F.transform(F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), lambda s: s["g"])
    n = F.length(text)
    least_b, most_b = F.ceil(n * (t / (2 - t)) - 1e-9), F.floor(n * ((2 - t) / t) + 1e-9)
    low, high = (F.greatest(F.ceil((n + b) * (t / 2) - 1e-9), F.lit(1)).cast("int") for b in (least_b, most_b))

    def keys(k: int) -> Column:
        # partners with which o is below k use shorter keys, so here o is k or more
        first = F.slice(ordered, 1, F.least(n, n - F.greatest(low, F.lit(k)) + k))
        rest = lambda i: F.slice(first, i + 2, F.greatest(F.size(first) - i - 1, F.lit(0)))
        if k == 1:
            joined = first
        elif k == 2:
            joined = F.flatten(F.transform(first, lambda x, i: F.transform(rest(i), lambda y: F.concat(x, y))))
        else:
            joined = F.flatten(F.flatten(F.transform(first, lambda x, i: F.transform(rest(i), lambda y, j: F.transform(rest(i + j + 1), lambda z: F.concat(x, y, z))))))
        return F.when((F.least(low, F.lit(3)) <= k) & (F.least(high, F.lit(3)) >= k), joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[keys(k) for k in (1, 2, 3)]))


def similar_pairs(a: DataFrame, b: DataFrame, column_a: str, column_b: str, tolerance: float = 0.8) -> DataFrame:
    """(column_a, column_b, ratio) of all pairs of distinct strings with at least the ratio.

    Strings so short that they may match without a shared pair meet by three shared letters at a time (``_letter_keys``).
    """
    left, right = a.select(column_a).filter(F.col(column_a).isNotNull()).distinct(), b.select(column_b).filter(F.col(column_b).isNotNull()).distinct()
    both = left.select(F.col(column_a).alias("s")).union(right.select(F.col(column_b).alias("s"))).distinct()
    frequency = both.filter(F.length("s") >= 2).select(F.explode(_pairs_of(F.col("s"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    frequency = durable(frequency)
    longer = _signatures(left, column_a, tolerance, frequency).join(_signatures(right, column_b, tolerance, frequency), "gram").select(column_a, column_b).distinct()
    # a + b letters guarantee a shared pair beyond 2 / (1.5 t - 1); below that shared letters make a candidate
    short = 2 / (1.5 * tolerance - 1) if tolerance > 2 / 3 + 1e-9 else float("inf")
    letters = lambda df, c: df.filter((F.length(c) <= short) & (F.length(c) > 0)).select(c, F.explode(_letter_keys(F.col(c), tolerance)).alias("key"))
    brief = letters(left, column_a).join(letters(right, column_b), "key").select(column_a, column_b).distinct()
    la, lb = F.length(column_a), F.length(column_b)
    near = longer.union(brief).distinct().filter(2 * F.least(la, lb) >= tolerance * (la + lb))
    return near.withColumn("ratio", ratio(F.col(column_a), F.col(column_b))).filter(F.col("ratio") >= tolerance)


def best_matches(a: DataFrame, b: DataFrame, column_a: str, column_b: str, tolerance: float = 0.8) -> DataFrame:
    """(column_a, column_b, ratio): the equal string, else the most similar; equals go to the first by name."""
    left, right = a.select(column_a).filter(F.col(column_a).isNotNull()).distinct(), b.select(column_b).filter(F.col(column_b).isNotNull()).distinct()
    exact = left.join(right, left[column_a] == right[column_b]).select(column_a, column_b, F.lit(1.0).alias("ratio"))
    rest = left.join(exact, column_a, "left_anti")
    pairs = similar_pairs(rest, right, column_a, column_b, tolerance)
    best = pairs.groupBy(column_a).agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col(column_b).alias("m"))).alias("x")).select(column_a, F.col("x.m").alias(column_b), (-F.col("x.r")).alias("ratio"))
    return exact.unionByName(best)


def groups(strings: DataFrame, column: str, tolerance: float = 0.8) -> DataFrame:
    """(column, representative): connected by similarity; the first by name stands for its group.

    A greedy grouping depends on the order in which strings come; components do not.
    """
    a = strings.select(F.col(column).alias("a")).filter("a IS NOT NULL").distinct()
    edges = similar_pairs(a, a.withColumnRenamed("a", "b"), "a", "b", tolerance).filter("a <> b").select("a", "b")
    found = components(edges)
    return a.join(found, a["a"] == found["node"], "left").select(F.col("a").alias(column), F.coalesce("component", "a").alias("representative"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``edges`` (a, b): the smallest node of each connected part.

    Large stars and small stars alternate (Kiveris and others 2014) until no edge changes, which
    takes a number of rounds that grows with the logarithm of the longest chain.
    """
    ordered = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = ordered.union(ordered.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour goes to the smallest node around
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour, and the node itself, goes to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = durable(small.filter("a <> b").distinct())
        same = after.count() == ordered.count() and not after.join(ordered, ["a", "b"], "left_anti").limit(1).count()
        ordered = after
        if same:
            break
    nodes = ordered.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(ordered.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
