"""Queries over identifiers, alignment, mapping and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import ids
from helixmill.operators import align, fuse, fuzzy, mapping
from helixmill.plans import adapters as a
from helixmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R = "round({0}, 6) + 0.0"


# --- identifiers -------------------------------------------------------------------------
_NAMES = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'tcga-a1-' || lpad((o_custkey % 9999)::VARCHAR, 4, '0') || '-01A-11R-A123-07' WHEN 1 THEN 'P' || lpad((o_custkey % 999)::VARCHAR, 3, '0') WHEN 2 THEN 'SAMPLE' || o_custkey
  WHEN 3 THEN 'ab-' || lpad((o_custkey % 99)::VARCHAR, 2, '0') WHEN 4 THEN ' Patient' || lpad((o_custkey % 99)::VARCHAR, 2, '0') || ' ' WHEN 5 THEN 'no id' WHEN 6 THEN '' ELSE 'x ' || lpad(o_custkey::VARCHAR, 5, '0') END AS raw FROM orders"""


def _names(spark: SparkSession, root: str) -> DataFrame:
    c, pad = F.col("o_custkey"), lambda n, m: F.lpad((F.col("o_custkey") % m).cast("string"), n, "0")
    k = F.col("o_orderkey") % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("tcga-a1-"), pad(4, 9999), F.lit("-01A-11R-A123-07"))).when(k == 1, F.concat(F.lit("P"), pad(3, 999))).when(k == 2, F.concat(F.lit("SAMPLE"), c.cast("string")))
        .when(k == 3, F.concat(F.lit("ab-"), pad(2, 99))).when(k == 4, F.concat(F.lit(" Patient"), pad(2, 99), F.lit(" "))).when(k == 5, F.lit("no id")).when(k == 6, F.lit("")).otherwise(F.concat(F.lit("x "), F.lpad(c.cast("string"), 5, "0")))
    )
    return table(spark, root, "orders").select("o_orderkey", raw.alias("raw"))


_PATIENT = "coalesce(" + ", ".join(f"nullif(upper(regexp_extract(trim(raw), '(?i){p}', 1)), '')" for p in ids.PATIENT_PATTERNS) + ", nullif(trim(raw), ''))"


@query(f"SELECT o_orderkey, {_PATIENT} AS patient_id FROM ({_NAMES})")
def extract_patient_id(spark: SparkSession, root: str) -> DataFrame:
    return _names(spark, root).select("o_orderkey", ids.patient_id(F.col("raw")).alias("patient_id"))


@query(f"SELECT o_orderkey, nullif(upper(regexp_extract(trim(raw), '(?i){ids.BARCODE_PATTERN}', 1)), '') AS barcode FROM ({_NAMES})")
def extract_barcode(spark: SparkSession, root: str) -> DataFrame:
    return _names(spark, root).select("o_orderkey", ids.barcode(F.col("raw")).alias("barcode"))


@query(f"""SELECT o_orderkey, CASE WHEN length(w) > 50 THEN substr(w, 1, 42) || h ELSE w END AS standard_id FROM (SELECT o_orderkey, substr(md5(raw), 1, 8) AS h,
    upper('geo_' || regexp_replace(raw, '[^A-Za-z0-9_-]', '_', 'g') || '_' || substr(md5(raw), 1, 8)) AS w FROM (SELECT o_orderkey, raw || ' / long enough to be cut ' || raw AS raw FROM ({_NAMES})))""")
def standard_sample_id(spark: SparkSession, root: str) -> DataFrame:
    raw = F.concat(F.col("raw"), F.lit(" / long enough to be cut "), F.col("raw"))
    return _names(spark, root).select("o_orderkey", ids.standard_id("geo", raw).alias("standard_id"))


_GENDER = "CASE lower(trim(gender)) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'man' THEN 'male' WHEN 'f' THEN 'female' WHEN 'female' THEN 'female' WHEN 'woman' THEN 'female' ELSE 'unknown' END"


@query(f"SELECT row_id, {_GENDER} AS gender, CASE WHEN NOT isnan(age) AND age BETWEEN 0 AND 120 THEN strftime(make_date((2024 - floor(age))::INT, 1, 1), '%Y-%m-%d') END AS birth_date FROM clinical")
def gender_birth_date(spark: SparkSession, root: str) -> DataFrame:
    age = F.when(F.col("age").between(0, 120), F.col("age"))
    return table(spark, root, "clinical").select("row_id", ids.gender(F.col("gender")).alias("gender"), F.date_format(ids.birth_date(age, 2024), "yyyy-MM-dd").alias("birth_date"))


# --- alignment ---------------------------------------------------------------------------
def _modalities(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Customers, customers with a finished order, and users, under one key."""
    return {
        "customer": table(spark, root, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"),
        "orders": table(spark, root, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")),
        "events": table(spark, root, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("value")),
    }


_MOD = """m AS (SELECT 'customer' AS modality, c_custkey AS id FROM customer UNION ALL SELECT DISTINCT 'orders', o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT 'events', user_id FROM events),
  common AS (SELECT id FROM m GROUP BY ALL HAVING count(*) = 3)"""


@query(f"WITH {_MOD} SELECT id::VARCHAR AS id FROM common")
def align_common_samples(spark: SparkSession, root: str) -> DataFrame:
    return align.common_ids(_modalities(spark, root), "id")


@query(f"WITH {_MOD} SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_custkey IN (SELECT id FROM common)")
def align_filter(spark: SparkSession, root: str) -> DataFrame:
    return align.align(_modalities(spark, root), "id")["customer"]


@query(f"WITH {_MOD} SELECT modality, count(*) AS n_samples, count(c.id) AS n_matched, {R.format('count(c.id) * 100.0 / count(*)')} AS matched_percent, count(*) - count(c.id) AS n_missing FROM m LEFT JOIN common c USING (id) GROUP BY ALL")
def alignment_stats(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(align.alignment_stats(_modalities(spark, root), "id"), ["matched_percent"])


@query(f"""WITH {_MOD}, s AS (SELECT modality, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT x.modality AS a, y.modality AS b, count(*) AS n_common FROM m x JOIN m y USING (id) GROUP BY ALL)
    SELECT a, b, n_common, {R.format('CASE WHEN a = b THEN n_common ELSE n_common / (s.n + t.n - n_common) END')} AS jaccard FROM p JOIN s ON s.modality = a JOIN s t ON t.modality = b""")
def overlap_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(align.overlap(_modalities(spark, root), "id"), ["jaccard"])


@query(f"""WITH {_MOD}, n AS (SELECT modality, count(*) AS n_rows FROM m GROUP BY ALL), b AS (SELECT n_rows AS base FROM n WHERE modality = 'customer'), x AS (SELECT modality, count(*) AS shared FROM m WHERE id IN (SELECT c_custkey FROM customer) GROUP BY ALL)
    SELECT modality, n_rows, n_rows = base AS same_length, n_rows = base AND coalesce(shared, 0) = base AS same_ids FROM n LEFT JOIN x USING (modality), b""")
def sample_consistency(spark: SparkSession, root: str) -> DataFrame:
    return align.consistency(_modalities(spark, root), "id")


@query("SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10')")
def match_by_time(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events").select(F.col("user_id").alias("id"), F.when(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"), F.col("ts")).alias("time"))
    orders = table(spark, root, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("time"))
    return align.match_by_time({"events": events, "orders": orders}, "id", "time")


def _patient_sql(key: str) -> str:
    """``_patient`` in DuckDB's dialect."""
    base36 = lambda n, width: " || ".join(f"('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ')[(({n}) // {36**p})::BIGINT % 36 + 1]" for p in range(width - 1, -1, -1))
    far = f"({key} - 12960000)"
    site = f"(CASE WHEN {far} < 0 THEN {key} // 10000 ELSE {far} // 1213056 END + {int('8A', 36)}) % 1296"
    return f"'TCGA-' || {base36(site, 2)} || '-' || CASE WHEN {far} < 0 THEN lpad(({key} % 10000)::VARCHAR, 4, '0') ELSE {base36(f'{far} % 1213056 + 466560', 4)} END"


_TWO = f"""l AS (SELECT {_patient_sql("c_custkey")} || '-01A' AS s FROM customer), r AS (SELECT DISTINCT lower({_patient_sql("o_custkey")}) || '-11B' AS s FROM orders WHERE o_orderstatus = 'F')"""


def _patient(key: str) -> Column:
    """TCGA-SS-NNNN, another one for every key up to 1.58 billion: the last four digits and, from 8A on, a site for the others.

    When the 1,296 sites of two letters or digits are used up, the last four begin with a letter.
    """
    k, sites, digits, letters = F.col(key).cast("bigint"), 36**2, 10**4, 26 * 36**3
    far = k - sites * digits
    site = F.floor(F.when(far < 0, k / digits).otherwise(far / letters))
    base36 = lambda n: F.conv(n.cast("string"), 10, 36)
    tail = F.when(far < 0, F.lpad((k % digits).cast("string"), 4, "0")).otherwise(base36(far % letters + 10 * 36**3))
    name = F.concat(F.lit("TCGA-"), F.lpad(base36((site + int("8A", 36)) % sites), 2, "0"), F.lit("-"), tail)
    return F.when((k >= 0) & (site < sites), name).when(k.isNotNull(), F.raise_error(F.concat(F.lit("no patient id for key "), k.cast("string"))))


def _two(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, root, "customer").select(F.concat(_patient("c_custkey"), F.lit("-01A")).alias("s"))
    right = table(spark, root, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lower(_patient("o_custkey")), F.lit("-11B")).alias("s")).distinct()
    return left, right


@query(f"WITH {_TWO} SELECT DISTINCT upper(l.s[1:12]) AS id FROM l JOIN r ON upper(l.s[1:12]) = upper(r.s[1:12])")
def match_patient_id(spark: SparkSession, root: str) -> DataFrame:
    left, right = _two(spark, root)
    return align.match_by({"a": left, "b": right}, {"a": "s", "b": "s"}, "patient")


@query(f"WITH {_TWO} SELECT DISTINCT upper(l.s[1:15]) AS id FROM l JOIN r ON upper(l.s[1:15]) = upper(regexp_replace(r.s, '-11B$', '-01B')[1:15])")
def match_barcode(spark: SparkSession, root: str) -> DataFrame:
    left, right = _two(spark, root)
    return align.match_by({"a": left, "b": right.select(F.regexp_replace("s", "-11B$", "-01B").alias("s"))}, {"a": "s", "b": "s"}, "barcode")


_MAP = """a AS (SELECT 'S-' || c_custkey AS id_a FROM customer), b AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'S-' || c_custkey WHEN 1 THEN 's-' || c_custkey WHEN 2 THEN 'S_' || c_custkey ELSE 'Z' || c_custkey END AS id_b FROM customer),
  x AS (SELECT id_a, id_b, CASE WHEN id_a = id_b THEN 'exact' WHEN lower(id_a) = lower(id_b) THEN 'case' ELSE 'punctuation' END AS how FROM a JOIN b ON id_a = id_b OR lower(id_a) = lower(id_b) OR replace(replace(id_a, '-', ''), '_', '') = replace(replace(id_b, '-', ''), '_', ''))"""


def _mapping(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, root, "customer"), F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 4
    other = F.when(m == 0, F.concat(F.lit("S-"), k)).when(m == 1, F.concat(F.lit("s-"), k)).when(m == 2, F.concat(F.lit("S_"), k)).otherwise(F.concat(F.lit("Z"), k))
    return c.select(F.concat(F.lit("S-"), k).alias("id_a")), c.select(other.alias("id_b"))


@query(f"WITH {_MAP} SELECT * FROM x")
def validate_mapping(spark: SparkSession, root: str) -> DataFrame:
    left, right = _mapping(spark, root)
    return align.validate_mapping(left, right, "id_a", "id_b")


@query(f"WITH {_MAP} SELECT count(*) AS n_matched, count(*) / (SELECT count(*) FROM customer) AS share, count(*) / (SELECT count(*) FROM customer) >= 0.8 AS valid FROM x")
def mapping_score(spark: SparkSession, root: str) -> DataFrame:
    left, right = _mapping(spark, root)
    return align.mapping_score(align.validate_mapping(left, right, "id_a", "id_b"), left, right, "id_a", "id_b")


def _entries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    typed = table(spark, root, "clinical").select(F.lower(F.trim("vital_status")).alias("typed")).filter("typed <> ''").distinct()
    return typed, table(spark, root, "code_list").select(F.explode(F.concat(F.array("entry"), "aliases")).alias("name")).select(F.lower("name").alias("name")).distinct()


@query()
def fuzzy_best_match(spark: SparkSession, root: str) -> DataFrame:
    typed, names = _entries(spark, root)
    return fuzzy.best_matches(typed, names, "typed", "name", 0.8)


@query()
def fuzzy_groups(spark: SparkSession, root: str) -> DataFrame:
    return fuzzy.groups(_entries(spark, root)[0], "typed", 0.9)


# --- mapping -----------------------------------------------------------------------------
_GENES = "e AS (SELECT gene_id, CASE WHEN expression_value >= 0 AND NOT isnan(expression_value) THEN expression_value END AS v FROM gene_expression), g AS (SELECT trim(ensembl) AS from_id, min(symbol) AS to_id FROM gene_mapping GROUP BY ALL)"


@query(f"WITH {_GENES} SELECT to_id AS symbol_id, count(*) AS n, {R.format('avg(v)')} AS mean FROM e JOIN g ON trim(gene_id) = from_id WHERE to_id <> '' GROUP BY ALL")
def map_ids_filter(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("expression_value")
    rows = table(spark, root, "gene_expression").select("gene_id", F.when((x >= 0) & ~F.isnan(x), x).alias("v"))
    mapped = mapping.map_ids(rows, "gene_id", table(spark, root, "gene_mapping"), "ensembl", "symbol")
    return a.tidy(mapped.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), ["mean"])


@query(f"WITH {_GENES}, d AS (SELECT DISTINCT gene_id FROM e WHERE trim(gene_id) <> '') SELECT count(*) AS n_ids, count(to_id) AS n_mapped, {R.format('count(to_id) * 100.0 / count(*)')} AS mapped_percent FROM d LEFT JOIN g ON trim(gene_id) = from_id")
def mapping_stats(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(mapping.mapping_stats(table(spark, root, "gene_expression"), "gene_id", table(spark, root, "gene_mapping"), "ensembl", "symbol"), ["mapped_percent"])


_DIRECTIONS = [(s, t) for s in mapping.KINDS for t in mapping.KINDS if s != t]


@query(" UNION ALL ".join(f"SELECT '{s}>{t}' AS direction, from_id, min({t}) AS to_id FROM (SELECT *, {'upper(trim(symbol))' if s == 'symbol' else f'trim({s})'} AS from_id FROM gene_mapping) WHERE from_id <> '' GROUP BY from_id HAVING min({t}) <> ''" for s, t in _DIRECTIONS))
def lookup_directions(spark: SparkSession, root: str) -> DataFrame:
    genes, out = table(spark, root, "gene_mapping"), None
    for s, t in _DIRECTIONS:
        part = mapping.lookup(genes, s, t).select(F.lit(f"{s}>{t}").alias("direction"), "from_id", "to_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN 'big ' || p_type END, p_type) AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand FROM part")
def consolidate_annotations(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    first = p.select("p_partkey", F.col("p_type").alias("kind"))
    second = p.filter("p_size > 25").select("p_partkey", F.concat(F.lit("big "), "p_type").alias("kind"))
    third = p.filter("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("brand"))
    return mapping.consolidate(p.select("p_partkey"), "p_partkey", [("first", first), ("second", second), ("third", third)], {"first": ["kind"], "second": ["kind"], "third": ["brand"]})


# --- fusion ------------------------------------------------------------------------------
_EVW = "evw AS (SELECT sample AS id, " + ", ".join(f"avg(value) FILTER (feature = '{t}') AS {t}" for t in a.EVENT_TYPES) + " FROM ev GROUP BY ALL)"
_ORD = "o AS (SELECT o_custkey AS id, sum(o_totalprice) AS total, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"
_CUS = "c AS (SELECT c_custkey AS id, c_acctbal FROM customer)"


def _views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    m = _modalities(spark, root)
    return {"events": a.event_wide(spark, root).withColumnRenamed("sample", "id"), "orders": m["orders"], "customer": m["customer"]}


@query(f"WITH {a.EVENTS}, {_EVW}, {_ORD}, {_CUS} SELECT evw.id, " + ", ".join(f"round({t}, 6) + 0.0 AS {t}" for t in a.EVENT_TYPES) + ", round(total, 2) + 0.0 AS orders_total, n_orders AS orders_n_orders, c_acctbal AS customer_c_acctbal FROM evw JOIN o USING (id) JOIN c USING (id)")
def merge_omics(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(a.tidy(fuse.merge(_views(spark, root), "id"), a.EVENT_TYPES), ["orders_total"], 2)


def _z(c: str) -> str:
    return f"(({c}) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)"


_ALIGNED = f"{a.EVENTS}, {_EVW}, {_ORD}, {_CUS}, k AS (SELECT id FROM evw JOIN o USING (id) JOIN c USING (id))"
_EARLY = {f"events_{t}": ("evw", t) for t in a.EVENT_TYPES} | {"orders_total": ("o", "total"), "orders_n_orders": ("o", "n_orders"), "customer_c_acctbal": ("c", "c_acctbal")}


@query(f"WITH {_ALIGNED} SELECT id, " + ", ".join(f"round({_z(f'{t}.{c}')}, 5) + 0.0 AS {n}" for n, (t, c) in _EARLY.items()) + " FROM k JOIN evw USING (id) JOIN o USING (id) JOIN c USING (id)")
def early_integration(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(fuse.early(_views(spark, root), "id"), list(_EARLY), 5)


@query(f"WITH {_ALIGNED} SELECT k.id, round({_z('total')}, 5) + 0.0 AS total, round({_z('n_orders')}, 5) + 0.0 AS n_orders FROM k JOIN o USING (id)")
def late_integration(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(fuse.late(_views(spark, root), "id")["orders"], ["total", "n_orders"], 5)


@query(f"WITH {a.EVENTS}, {_EVW}, {a.CLINICAL} SELECT evw.id, round(click, 6) + 0.0 AS click, round(s, 5) + 0.0 AS clinical_c_acctbal, c_mktsegment AS clinical_c_mktsegment, r_name AS clinical_r_name FROM evw LEFT JOIN (SELECT *, {_z('c_acctbal')} AS s FROM cl) z ON z.c_custkey = evw.id")
def clinical_left_join(spark: SparkSession, root: str) -> DataFrame:
    clinical = a.clinical_like(spark, root).select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", "r_name")
    out = fuse.with_clinical(_views(spark, root)["events"].select("id", "click"), clinical, "id")
    return a.tidy(a.tidy(out, ["click"]), ["clinical_c_acctbal"], 5)


@query()
def intermediate_integration(spark: SparkSession, root: str) -> DataFrame:
    vectors = a.embedded_wide(spark, root).drop("label").withColumnRenamed("sample", "id")
    return fuse.intermediate({"vectors": vectors, "events": _views(spark, root)["events"]}, "id", components=10)


@query(f"""WITH {a.EVENTS}, {_EVW}, {_ORD} SELECT 'events' AS modality, count(*) AS n_samples, 5::BIGINT AS n_features, {R.format("sum(" + " + ".join(f"({t} IS NULL OR {t} <> 0)::INT" for t in a.EVENT_TYPES) + ") / (count(*) * 5)")} AS density, {R.format('count(*) / 5.0')} AS samples_per_feature FROM evw
    UNION ALL SELECT 'orders', count(*), 2, {R.format('sum((total IS NULL OR total <> 0)::INT + (n_orders <> 0)::INT) / (count(*) * 2)')}, {R.format('count(*) / 2.0')} FROM o""")
def integration_metrics(spark: SparkSession, root: str) -> DataFrame:
    v = _views(spark, root)
    return a.tidy(fuse.metrics({"events": v["events"], "orders": v["orders"]}, "id"), ["density", "samples_per_feature"])


@query(f"WITH {a.EVENTS}, {_EVW}, {_ORD}, x AS (SELECT 'events' AS modality, count(*) AS n FROM evw UNION ALL SELECT 'orders', count(*) FROM o) SELECT modality, {R.format('n / max(n) OVER ()')} AS n_samples FROM x")
def integration_comparison(spark: SparkSession, root: str) -> DataFrame:
    v = _views(spark, root)
    rows = fuse.metrics({"events": v["events"], "orders": v["orders"]}, "id").select("modality", "n_samples")
    return a.tidy(fuse.relative_metrics(rows, ["n_samples"]), ["n_samples"])


@query(f"WITH {_ALIGNED} SELECT id, 'events_' || feature AS feature, {R.format('value')} AS value FROM k JOIN ev ON ev.sample = k.id UNION ALL SELECT id, 'orders_total', {R.format('total')} FROM k JOIN o USING (id) UNION ALL SELECT id, 'orders_n_orders', n_orders FROM k JOIN o USING (id) UNION ALL SELECT id, 'customer_c_acctbal', c_acctbal FROM k JOIN c USING (id)")
def feature_matrix_long(spark: SparkSession, root: str) -> DataFrame:
    return a.tidy(fuse.feature_vectors(_views(spark, root), "id"), ["value"])


# --- set operations ----------------------------------------------------------------------
@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, root, "orders").select("o_custkey"))


@query("SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders")
def union_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(F.col("user_id").alias("id")).union(table(spark, root, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, root, "orders"), F.col("id") == F.col("o_custkey"), "left_anti")


@query("SELECT s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def row_concat(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)
