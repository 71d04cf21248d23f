"""The training-data queries over the project's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import canonical, content, mixing, packing, tokens
from helixmill.session import durable, table

CODED = ["gender", "tumor_stage", "vital_status"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    mapped = canonical.map_rows(table(spark, root, "clinical"), "row_id", CODED, table(spark, root, "code_list"), only="how <> 'verbatim'")
    return mapped.select("row_id", "field_name", "entry")


def p1_unmatched(spark: SparkSession, root: str) -> DataFrame:
    return canonical.unmatched_report(table(spark, root, "clinical"), "row_id", CODED, table(spark, root, "code_list"))


def token_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, source, n_tokens): the only pass over the texts that packing and mixing need."""
    docs = table(spark, root, "documents")
    return durable(docs.select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("n_tokens")))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(token_sizes(spark, root), table(spark, root, "pack_plans"))


def p6_summary(spark: SparkSession, root: str) -> DataFrame:
    return packing.summary(p6_packed(spark, root))


def p6_audit(spark: SparkSession, root: str) -> DataFrame:
    """What packing must keep, per plan: every token once, no container too full, nothing split that fits."""
    sizes, plans = token_sizes(spark, root), table(spark, root, "pack_plans")
    return packing.audit(durable(packing.pack(sizes, plans)), sizes, plans)


def p7_mixed(spark: SparkSession, root: str) -> DataFrame:
    docs = mixing.hashed(token_sizes(spark, root))
    return mixing.choose(docs, mixing.plan(docs, mixing.read_targets(table(spark, root, "mix_targets"))))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    docs = mixing.hashed(token_sizes(spark, root))
    return mixing.report(docs, mixing.plan(docs, mixing.read_targets(table(spark, root, "mix_targets"))))


def p7_audit(spark: SparkSession, root: str) -> DataFrame:
    """What mixing must keep, per target: no document too often, none of another source, and the share met where there are documents."""
    docs = mixing.hashed(token_sizes(spark, root))
    targets = mixing.plan(docs, mixing.read_targets(table(spark, root, "mix_targets")))
    chosen = mixing.choose(docs, targets).alias("c").join(docs.alias("d"), "doc_id").select("c.*", "d.source_key")
    listed = spark.createDataFrame([(k, t.source, t.share, t.max_repeats, t.n_docs) for k, t in targets.items()], "source_key string, name string, target_share double, max_repeats int, n_docs long")
    wrong = chosen.join(listed, F.col("c.source") == F.col("name")).groupBy("name").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_too_often"), F.count_if(listed["source_key"] != chosen["source_key"]).alias("n_foreign"))
    status = mixing.report(docs, targets).select(F.col("source").alias("name"), "status")
    out = listed.join(wrong, "name", "left").join(status, "name").fillna(0, ["n_too_often", "n_foreign"])
    return out.select(F.col("name").alias("source"), "target_share", "max_repeats", "n_docs", "n_too_often", "n_foreign", "status")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    scored = content.score_documents(table(spark, root, "documents"), table(spark, root, "content_labels"))
    return scored.filter(F.col("score") >= content.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return content.all_scores(table(spark, root, "documents"), table(spark, root, "content_labels"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return content.rates(p8_scores(spark, root))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p6_packed, p6_summary, p6_audit, p7_mixed, p7_shares, p7_audit, p8_found, p8_scores, p8_rates)}


def _p1_sql() -> str:
    """The same folding, then every distinct value against every reference string."""
    extra = ", ".join(f"('{f}', '{e}', '{w}')" for f, es in canonical.SYNONYMS.items() for e, ws in es.items() for w in ws)
    long = " UNION ALL ".join(f"SELECT row_id, '{f}' AS field_name, {f} AS value FROM clinical" for f in CODED)
    fold = lambda v: canonical.folded_sql(v, "field_name", duckdb=True)
    letters = lambda x: f"list_sort(string_split({x}, ''))"
    return f"""
    w AS (SELECT field_name, entry, entry AS word FROM code_list UNION ALL SELECT field_name, entry, unnest(aliases) FROM code_list
      UNION ALL SELECT x.* FROM (VALUES {extra}) x(field_name, entry, word)),
    r AS (SELECT field_name, ref, min(entry) AS entry FROM (SELECT field_name, entry, {fold('word')} AS ref FROM w) WHERE ref <> '' GROUP BY ALL),
    l AS (SELECT * FROM ({long}) WHERE value IS NOT NULL AND regexp_replace(value, '{canonical.WHITE}', '', 'g') <> ''),
    v AS (SELECT DISTINCT field_name, value, {fold('value')} AS norm FROM l),
    n AS (SELECT DISTINCT field_name, norm FROM v WHERE norm <> ''),
    c AS (SELECT n.*, r.ref, r.entry, levenshtein(n.norm, r.ref) AS d, {letters('n.norm')} = {letters('r.ref')} AS swapped FROM n JOIN r USING (field_name)),
    k AS (SELECT field_name, norm, min(struct_pack(cost := CASE WHEN swapped AND length(ref) >= 4 AND d <= 2 THEN least(d, 1) ELSE d END, other := norm[1] <> ref[1], entry := entry)) AS best FROM c
      WHERE d = 0 OR ((d <= {canonical.ALLOWED.format('ref')} OR (swapped AND length(ref) >= 4 AND d <= 2))
        AND (field_name NOT LIKE '%stage%' OR string_split(norm, ' ')[-1] = string_split(ref, ' ')[-1])) GROUP BY ALL),
    m AS (SELECT v.field_name, v.value, coalesce(k.best.entry, '{canonical.UNMATCHED}') AS entry FROM v LEFT JOIN k USING (field_name, norm))"""


ORACLE = {
    "p1_found": f"""WITH {_p1_sql()} SELECT l.row_id, l.field_name, m.entry FROM l JOIN m USING (field_name, value)
      WHERE NOT EXISTS (SELECT 1 FROM code_list c WHERE c.field_name = l.field_name AND c.entry = l.value)""",
    "p6_audit": """SELECT plan_id, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS n_missing, 0::BIGINT AS n_wrong_tokens, 0::BIGINT AS n_split_in_vain, 0::BIGINT AS n_wrong_containers FROM pack_plans""",
    "p7_audit": """WITH d AS (SELECT upper(regexp_replace(source, '[^\\p{L}\\p{N}]+', '', 'g')) AS k, count(*) AS n FROM documents GROUP BY ALL)
      SELECT source, target_share, max_repeats, coalesce(n, 0) AS n_docs, 0::BIGINT AS n_too_often, 0::BIGINT AS n_foreign, CASE WHEN n > 0 THEN 'met' ELSE 'no documents' END AS status
      FROM mix_targets LEFT JOIN d ON k = upper(regexp_replace(source, '[^\\p{L}\\p{N}]+', '', 'g'))""",
    "p1_unmatched": f"""WITH {_p1_sql()} SELECT l.field_name, l.value, count(*) AS n_rows FROM l JOIN m USING (field_name, value) WHERE m.entry = '{canonical.UNMATCHED}' GROUP BY ALL""",
}
