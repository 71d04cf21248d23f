"""Mapping free-entered values to a canonical list, in SQL only.

Distinct values are folded (case, marks, brackets, labels, numerals) and compared with the
folded entries, aliases and synonyms of their field. What is not equal goes through a
partition-based join: a reference string that may differ in k edits is cut into k + 1
segments, of which one must occur unchanged at nearly the same place, so candidates come
from an equality join on positional substrings and only these are verified with the
built-in levenshtein. Whatever no join has matched is found by an anti-join and reported.

Only distinct values take part; rows meet the finished mapping once. The engine sends the mapping to all
tasks where its measured size allows it, and else splits the partition of a value that holds a large part of the rows.

Defined cases: NULL and blank values are neither mapped nor reported; text of nothing but
punctuation is unmatched; values that say they are unknown are unmatched; of equally close
entries the one with the same first letter wins, then the first by name; repeated rows
and values change nothing; an empty list leaves every value unmatched; very long
values are unmatched, since no reference string is nearly as long; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from helixmill.functions.text import MARKED, PLAIN
from helixmill.session import durable

#: White space of any kind, as a pattern without a backslash.
WHITE = "[\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
UNMATCHED = "unmatched"

# Further words for the entries of the three fields.
SYNONYMS: dict[str, dict[str, list[str]]] = {
    "gender": {
        "male": ["boy", "gentleman", "guy", "mann", "junge", "herr", "hombre", "varon", "masculino", "chico", "garcon", "mâle", "monsieur", "masc"],
        "female": ["girl", "lady", "frau", "mädchen", "dame", "mujer", "femenino", "chica", "femelle", "fille", "madame", "fem"],
        "other": ["nonbinary", "enby", "genderqueer", "agender", "third gender", "divers", "nicht binär", "non binaire", "no binario", "intersexe", "intersexual", "otro", "andere"],
    },
    "vital_status": {
        "alive": ["living", "still alive", "live", "lives", "survivor", "survived", "surviving", "lebend", "am leben", "lebt", "vivant", "vivante", "en vie", "vivo", "viva", "con vida"],
        "dead": ["died", "deceased", "expired", "passed away", "dead of disease", "demised", "death", "verstorben", "gestorben", "tot", "exitus", "décédé", "décédée", "mort", "morte", "fallecido", "fallecida", "muerto", "muerta"],
        "lost to follow-up": ["ltfu", "lost", "lost contact", "no contact", "untraceable", "unreachable", "no longer reachable", "not reachable", "perdu de vue", "perdue de vue", "injoignable", "nicht erreichbar", "perdido", "perdido de vista"],
    },
}

# Words before a value that only name its field, remarks after it, and words for a stage.
LABELS = "sex|sexe|sexo|gender|genre|geschlecht|status|statut|estado|vital status|vitalstatus"
REMARKS = "confirmed|checked|verified|per chart|self reported|reported by patient"
STAGE_WORDS = "stage|stages|stadium|stade|estadio|stadio|stad|stg|st"


def folded_sql(value: str, field: str, duckdb: bool = False) -> str:
    """SQL for the folded form of ``value``, in Spark's or DuckDB's dialect.

    No pattern holds a backslash or a brace, so the text means the same in both.
    """
    every = ", 'g'" if duckdb else ""
    sub = lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', '{to}'{every})"
    # names an expression, so that it is computed once however often the body uses it
    bind = lambda x, name, body: f"list_transform([{x}], lambda {name}: {body})[1]" if duckdb else f"element_at(transform(array({x}), {name} -> {body}), 1)"
    x = f"translate(lower({value}), '{MARKED}', '{PLAIN}')"
    x = sub(x, "[̀-ͯ]", "")
    for glyph, letters in (("ⅳ", "iv"), ("ⅲ", "iii"), ("ⅱ", "ii"), ("ⅰ", "i")):
        x = f"replace({x}, '{glyph}', '{letters}')"
    x = f"translate({x}, '[]<>–—', '()()--')"
    x = sub(x, "[(][^)]*[)]?", " ")
    x = sub(x, "[ ]-[ ]+[a-z][a-z][a-z][a-z ]*$", " ")
    x = f"trim({sub(x, '[^a-z0-9]+', ' ')})"
    x = sub(x, f"^({LABELS}) +", "")
    x = sub(x, f"( ({REMARKS}))+$", "")
    bare = sub(sub("folded", "^(ajcc|uicc|figo|tnm) +", ""), " +(ajcc|uicc|figo|tnm)$", "")
    parts = "^(.*?) *([il]v|[il][il]?[il]?|[1-4]|one|two|three|four) *([abc]?)$"
    get = lambda i: f"regexp_extract(bare, '{parts}', {i})"
    arabic = " ".join(f"WHEN '{n}' THEN '{r}'" for r, ns in (("i", ("1", "one")), ("ii", ("2", "two")), ("iii", ("3", "three")), ("iv", ("4", "four"))) for n in ns)
    roman = f"CASE num {arabic} ELSE translate(num, 'l', 'i') END"
    word = f"CASE WHEN regexp_extract(concat(head, '.'), '^([pc]?({STAGE_WORDS})|)[.]$', 0) <> '' THEN 'stage' ELSE head END"
    staged = bind(get(2), "num", f"CASE WHEN num = '' THEN bare ELSE concat({bind(f'trim({get(1)})', 'head', word)}, ' ', {roman}, {get(3)}) END")
    return bind(x, "folded", f"CASE WHEN {field} LIKE '%stage%' THEN {bind(bare, 'bare', staged)} ELSE folded END")


#: Edits allowed in a reference string of a length; two more letters swapped are allowed from 4 letters on.
ALLOWED = "CASE WHEN length({0}) < 4 THEN 0 WHEN length({0}) < 8 THEN 1 WHEN length({0}) < 12 THEN 2 WHEN length({0}) < 16 THEN 3 ELSE 4 END"
SEARCHED = "CASE WHEN length({0}) < 4 THEN 0 WHEN length({0}) < 12 THEN 2 WHEN length({0}) < 16 THEN 3 ELSE 4 END"
MOST_EDITS = 4


def reference_strings(spark: SparkSession, codes: DataFrame, synonyms: Mapping[str, Mapping[str, Sequence[str]]] = SYNONYMS) -> DataFrame:
    """(field_name, entry, ref): every folded way of writing an entry."""
    extra = spark.createDataFrame([(f, e, w) for f, es in synonyms.items() for e, ws in es.items() for w in ws], "field_name string, entry string, word string")
    return spark.sql(
        f"""WITH words AS (
              SELECT field_name, entry, entry AS word FROM {{codes}}
              UNION ALL SELECT field_name, entry, explode(aliases) FROM {{codes}}
              UNION ALL SELECT x.field_name, x.entry, x.word FROM {{extra}} x LEFT SEMI JOIN {{codes}} c ON c.field_name = x.field_name AND c.entry = x.entry)
            SELECT field_name, ref, min(entry) AS entry FROM (SELECT field_name, entry, {folded_sql("word", "field_name")} AS ref FROM words WHERE entry IS NOT NULL AND word IS NOT NULL)
            WHERE ref <> '' GROUP BY field_name, ref""",
        codes=codes, extra=extra,
    )


def long_values(rows: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, field_name, value) of every value that is neither NULL nor blank."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    return rows.sparkSession.sql(
        f"""SELECT row_id, field_name, value FROM (SELECT `{row_id}` AS row_id, stack({len(fields)}, {pairs}) AS (field_name, value) FROM {{rows}})
            WHERE value IS NOT NULL AND regexp_replace(value, '{WHITE}', '') <> ''""",
        rows=rows,
    )


def value_mapping(values: DataFrame, codes: DataFrame, refs: DataFrame) -> DataFrame:
    """(field_name, value, entry, how) for distinct ``values`` (field_name, value).

    ``how`` is verbatim, synonym, close or none.
    """
    spark = values.sparkSession
    typed = durable(spark.sql(f"SELECT field_name, value, {folded_sql('value', 'field_name')} AS norm FROM {{values}}", values=values))
    norms = spark.sql("SELECT DISTINCT n.field_name, n.norm FROM {typed} n LEFT ANTI JOIN {refs} r ON r.field_name = n.field_name AND r.ref = n.norm WHERE n.norm <> ''", typed=typed, refs=refs)
    segments = spark.sql(
        f"""WITH cut AS (SELECT field_name, ref, entry, length(ref) AS len, {SEARCHED.format("ref")} AS k FROM {{refs}} WHERE length(ref) >= 4),
              part AS (SELECT *, explode(sequence(0, k)) AS no FROM cut)
            SELECT field_name, ref, entry, len, k, no, (len * no) DIV (k + 1) + 1 AS at, substring(ref, (len * no) DIV (k + 1) + 1, (len * (no + 1)) DIV (k + 1) - (len * no) DIV (k + 1)) AS piece FROM part""",
        refs=refs,
    )
    close = spark.sql(
        f"""WITH lens AS (SELECT DISTINCT field_name, len, k, no, at, length(piece) AS size FROM {{segments}}),
              near AS (SELECT field_name, norm, explode(sequence(greatest(length(norm) - {MOST_EDITS}, 1), length(norm) + {MOST_EDITS})) AS len FROM {{norms}}),
              probe AS (SELECT n.field_name, n.norm, l.len, l.no, explode(sequence(greatest(l.at - l.k, 1), l.at + l.k)) AS start, l.size FROM near n JOIN lens l ON l.field_name = n.field_name AND l.len = n.len WHERE abs(length(n.norm) - l.len) <= l.k),
              cand AS (SELECT DISTINCT p.field_name, p.norm, s.ref, s.entry FROM probe p JOIN {{segments}} s
                ON s.field_name = p.field_name AND s.len = p.len AND s.no = p.no AND s.piece = substring(p.norm, p.start, p.size)),
              told AS (SELECT *, levenshtein(norm, ref) AS d, array_sort(split(norm, '')) = array_sort(split(ref, '')) AS swapped FROM cand),
              kept AS (SELECT *, CASE WHEN swapped AND d <= 2 THEN 1 ELSE d END AS cost FROM told
                WHERE (d <= {ALLOWED.format("ref")} OR (swapped AND d <= 2)) AND (field_name NOT LIKE '%stage%' OR substring_index(norm, ' ', -1) = substring_index(ref, ' ', -1)))
            SELECT field_name, norm, min(struct(cost, left(norm, 1) <> left(ref, 1) AS other, entry)).entry AS entry FROM kept GROUP BY field_name, norm""",
        segments=segments, norms=norms,
    )
    known = spark.sql(
        "SELECT field_name, ref AS norm, entry, 'synonym' AS how FROM {refs} UNION ALL SELECT field_name, norm, entry, 'close' FROM {close}", refs=refs, close=durable(close)
    )
    return spark.sql(
        f"""WITH mapped AS (SELECT t.field_name, t.value, coalesce(c.entry, k.entry) AS entry, CASE WHEN c.entry IS NOT NULL THEN 'verbatim' ELSE k.how END AS how
                FROM {{typed}} t JOIN {{known}} k ON k.field_name = t.field_name AND k.norm = t.norm
                LEFT JOIN (SELECT DISTINCT field_name, entry FROM {{codes}}) c ON c.field_name = t.field_name AND c.entry = t.value)
            SELECT * FROM mapped
            UNION ALL SELECT t.field_name, t.value, '{UNMATCHED}', 'none' FROM {{typed}} t LEFT ANTI JOIN {{known}} k ON k.field_name = t.field_name AND k.norm = t.norm""",
        typed=typed, known=known, codes=codes,
    )


def map_rows(rows: DataFrame, row_id: str, fields: Sequence[str], codes: DataFrame, only: str = "true") -> DataFrame:
    """(row_id, field_name, value, entry, how) of every value; ``only`` filters the mapping by SQL."""
    spark = rows.sparkSession
    long = long_values(rows, row_id, fields)
    values = spark.sql("SELECT DISTINCT field_name, value FROM {long}", long=long)
    mapping = value_mapping(values, codes, durable(reference_strings(spark, codes)))
    return spark.sql(
        f"SELECT l.row_id, l.field_name, l.value, m.entry, m.how FROM {{long}} l JOIN (SELECT * FROM {{mapping}} WHERE {only}) m ON m.field_name = l.field_name AND m.value = l.value",
        long=long, mapping=durable(mapping),
    )


def unmatched_report(rows: DataFrame, row_id: str, fields: Sequence[str], codes: DataFrame) -> DataFrame:
    """(field_name, value, n_rows) of the values that mean no entry."""
    spark = rows.sparkSession
    long = long_values(rows, row_id, fields)
    counts = durable(spark.sql("SELECT field_name, value, count(*) AS n_rows FROM {long} GROUP BY field_name, value", long=long))
    mapping = value_mapping(counts.select("field_name", "value"), codes, durable(reference_strings(spark, codes)))
    return spark.sql("SELECT c.* FROM {counts} c LEFT ANTI JOIN (SELECT * FROM {mapping} WHERE how <> 'none') m ON m.field_name = c.field_name AND m.value = c.value", counts=counts, mapping=mapping)
