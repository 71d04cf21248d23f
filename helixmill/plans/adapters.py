"""Matrices made of the star-schema tables, as frames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.session import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINES = list(range(1, 8))
DIMS = 64
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def tidy(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def counts(spark: SparkSession, root: str) -> DataFrame:
    """(sample, feature, value): quantities by supplier and brand."""
    joined = table(spark, root, "lineitem").join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def lengths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") * 100).alias("length"))


def sparse(spark: SparkSession, root: str) -> DataFrame:
    """Wide: mean price by order (sample) and line number (n1 to n7); about half of it missing."""
    wide = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).pivot("l_linenumber", LINES).agg(F.avg("l_extendedprice"))
    return wide.withColumnsRenamed({str(i): f"n{i}" for i in LINES})


def embedded(spark: SparkSession, root: str, gaps: bool = False) -> DataFrame:
    """(sample, label, feature, value) of the vectors' numbers; with ``gaps`` every eleventh is missing."""
    long = table(spark, root, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    if gaps:
        value = F.when(F.pmod(F.col("sample") * 7 + F.col("i") * 3, F.lit(11)) != 0, value)
    return long.select("sample", "label", F.concat(F.lit("d"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), value.alias("value"))


def embedded_wide(spark: SparkSession, root: str) -> DataFrame:
    """(sample, label, d00, d01, ...)."""
    e = table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), "label", *[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(DIMS)])


def event_means(spark: SparkSession, root: str) -> DataFrame:
    """(sample, feature, value): mean value by user and type of event."""
    return table(spark, root, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))


def event_wide(spark: SparkSession, root: str, gaps: bool = False) -> DataFrame:
    wide = event_means(spark, root).groupBy("sample").pivot("feature", EVENT_TYPES).agg(F.first("value"))
    if gaps:
        wide = wide.withColumns({c: F.when(F.pmod(F.col("sample") * 7 + len(c) * 3, F.lit(11)) != 0, F.col(c)) for c in EVENT_TYPES})
    return wide


def clinical_like(spark: SparkSession, root: str) -> DataFrame:
    c, n, r = table(spark, root, "customer"), table(spark, root, "nation"), table(spark, root, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_acctbal", "c_mktsegment", "n_name", "r_name")


# the same frames in SQL, to stand in a WITH clause
COUNTS = "counts AS (SELECT l_suppkey AS sample, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
LENGTHS = "lengths AS (SELECT p_brand AS feature, avg(p_size) * 100 AS length FROM part GROUP BY ALL)"
SPARSE = "sparse AS (SELECT l_orderkey AS sample, " + ", ".join(f"avg(l_extendedprice) FILTER (l_linenumber = {i}) AS n{i}" for i in LINES) + " FROM lineitem GROUP BY ALL)"
SPARSE_LONG = SPARSE + ", sparse_long AS (SELECT sample, feature, value FROM (FROM sparse UNPIVOT INCLUDE NULLS (value FOR feature IN (n1, n2, n3, n4, n5, n6, n7))))"
_EMB = "SELECT vec_id AS sample, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings"
EMB = f"emb AS (SELECT sample, label, 'd' || lpad(i::VARCHAR, 2, '0') AS feature, v AS value FROM ({_EMB}))"
EMB_GAPS = f"emb AS (SELECT sample, label, 'd' || lpad(i::VARCHAR, 2, '0') AS feature, CASE WHEN (sample * 7 + i * 3) % 11 <> 0 THEN v END AS value FROM ({_EMB}))"
EVENTS = "ev AS (SELECT user_id AS sample, event_type AS feature, avg(value) AS value FROM events GROUP BY ALL)"
EVENTS_GAPS = "ev AS (SELECT u.sample, t.feature, CASE WHEN (u.sample * 7 + length(t.feature) * 3) % 11 <> 0 THEN value END AS value FROM (SELECT DISTINCT user_id AS sample FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS feature FROM events) t LEFT JOIN (SELECT user_id AS sample, event_type AS feature, avg(value) AS value FROM events GROUP BY ALL) e USING (sample, feature))"
CLINICAL = "cl AS (SELECT c_custkey, c_acctbal, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
