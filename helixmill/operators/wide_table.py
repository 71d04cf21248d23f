"""Entity, attribute, value rows into wide tables by characteristic sets.

A cell is what all rows of one entity and attribute say together. Entities with the same
set of attributes form a characteristic set and get one dense table, holding exactly the
columns of the set; sets of fewer than ``min_support`` entities are merged into one
generalised set over all attributes, since a table for every entity would be no table at
all. The tables are then joined by ``unionByName(allowMissingColumns=True)``.

Rows are combined into cells before they are shuffled, so an entity or attribute with a
large part of the rows costs no more than its number of cells. An entity never has more
cells than there are attributes, whose number is checked against ``max_attributes``.

Defined cases: rows with a NULL or blank entity or attribute, or with an attribute not in
the list, make no cell; NULL, NaN and negative values are no values, but the entity still
gets its row and the attribute still counts in its set; repeated rows change nothing;
of competing values the latest stands (by ``order``, then the smallest); an empty table
gives an empty wide table with all columns. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.errors import PreprocessingError
from helixmill.functions.text import clean_number, id_key, versioned_id_key
from helixmill.session import durable


#: Attributes that are numbered in one table sent to all tasks; some tens of megabytes.
MOST_NUMBERED = 500_000


@dataclass(frozen=True)
class WideSpec:
    """Where entity, attribute and value are, and what the attributes are called."""

    entity: str
    attribute: str
    value: str
    attributes: Sequence[str]
    order: Sequence[str] = field(default_factory=tuple)
    tolerance: float = 0.001
    min_support: int = 1000
    max_tables: int = 16
    max_attributes: int = 5000


def attribute_names(table: DataFrame, column: str, limit: int = 5000) -> list[str]:
    """The names of the wide columns; refuses more than ``limit`` of them."""
    names = [r[0] for r in table.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(names) > limit:
        raise PreprocessingError(f"more than {limit} attributes: {column} does not name wide columns")
    return names


def cells(rows: DataFrame, spec: WideSpec) -> DataFrame:
    """(entity_key, attribute_no, value, competing) with one row per entity and attribute."""
    spark = rows.sparkSession
    if len(spec.attributes) > spec.max_attributes:
        raise PreprocessingError(f"more than {spec.max_attributes} attributes; wide_blocks takes any number up to {MOST_NUMBERED}")
    number = clean_number(F.col(f"`{spec.value}`"))
    raw = rows.select(
        id_key(F.col(f"`{spec.entity}`")).alias("entity_key"),
        versioned_id_key(F.col(f"`{spec.attribute}`")).alias("attribute_key"),
        F.when(number >= 0, number).alias("value"),
        *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(spec.order)],
    ).filter("entity_key != '' AND attribute_key != ''")
    # as many rows as max_attributes allows, so broadcasting them is safe at any input size
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(spec.attributes)], "name string, attribute_no int")
    numbered = numbered.select(versioned_id_key(F.col("name")).alias("attribute_key"), "attribute_no")
    known = raw.join(F.broadcast(numbered), "attribute_key")
    order = [F.col(f"_o{i}") for i in range(len(spec.order))]
    latest = F.max(F.when(F.col("value").isNotNull(), F.struct(*order, (-F.col("value")).alias("v"))))
    return known.groupBy("entity_key", "attribute_no").agg(
        (-latest["v"]).alias("value"),
        F.coalesce(F.max("value") - F.min("value") > spec.tolerance, F.lit(False)).alias("competing"),
    )


def entities(cell: DataFrame) -> DataFrame:
    """(entity_key, signature, vals, competing): one row per entity; signature orders vals."""
    packed = F.array_sort(F.collect_list(F.struct("attribute_no", "value", "competing")))
    per = cell.groupBy("entity_key").agg(packed.alias("p"))
    return per.select(
        "entity_key",
        F.transform("p", lambda x: x["attribute_no"]).alias("signature"),
        F.transform("p", lambda x: x["value"]).alias("vals"),
        F.transform(F.filter("p", lambda x: x["competing"]), lambda x: x["attribute_no"]).alias("competing"),
    )


def frequent_signatures(entity: DataFrame, spec: WideSpec) -> list[list[int]]:
    """The attribute sets of at least ``min_support`` entities, the ``max_tables`` most frequent."""
    counts = entity.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= spec.min_support)
    return [list(r["signature"]) for r in counts.orderBy(F.desc("n"), "signature").limit(spec.max_tables).collect()]


def signature_report(entity: DataFrame) -> DataFrame:
    """How many characteristic sets there are and how many entities the largest has."""
    counts = entity.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_signatures"), F.sum("n").alias("n_entities"), F.max("n").alias("largest"), F.max(F.size("signature")).alias("most_attributes"))


def to_wide(rows: DataFrame, spec: WideSpec) -> DataFrame:
    """entity_key, one double column per attribute, and ``competing`` (array of attribute names)."""
    per_entity = durable(entities(cells(rows, spec)))
    names = F.array(*[F.lit(n) for n in spec.attributes]) if spec.attributes else F.array().cast("array<string>")
    told = F.transform("competing", lambda i: F.element_at(names, i + 1)).alias("competing")
    frequent = frequent_signatures(per_entity, spec)
    tables = []
    for signature in frequent:
        exact = per_entity.filter(F.col("signature") == F.array(*[F.lit(i) for i in signature]))
        tables.append(exact.select("entity_key", *[F.col("vals")[k].alias(spec.attributes[i]) for k, i in enumerate(signature)], told))
    rest = per_entity
    if frequent:
        rest = rest.filter(~F.col("signature").isin([F.array(*[F.lit(i) for i in s]) for s in frequent]))
    # array_position looks through the signature for every attribute, which is cheap for some hundreds of them; 0 where absent
    place = lambda i: F.array_position("signature", i)
    tables.append(rest.select("entity_key", *[F.try_element_at("vals", F.nullif(place(i), F.lit(0)).cast("int")).alias(n) for i, n in enumerate(spec.attributes)], told))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select("entity_key", *[F.col(f"`{n}`").cast(T.DoubleType()).alias(n) for n in spec.attributes], "competing")


def wide_blocks(rows: DataFrame, spec: WideSpec, width: int = 1000) -> Iterator[tuple[list[str], DataFrame]]:
    """The wide table of any number of attributes as tables of at most ``width`` of them: (names, entity_key and columns).

    Every entity has a row in every table, so they can be stored side by side or joined. Cells are made once.
    """
    cell = durable(cells(rows, replace(spec, max_attributes=MOST_NUMBERED)))
    every = durable(cell.select("entity_key").distinct())
    for start in range(0, len(spec.attributes), width):
        names = list(spec.attributes[start : start + width])
        inside = cell.filter((F.col("attribute_no") >= start) & (F.col("attribute_no") < start + len(names)))
        # a cell is one row, so first takes it as it is
        block = inside.groupBy("entity_key").pivot("attribute_no", list(range(start, start + len(names)))).agg(F.first("value"))
        named = block.select("entity_key", *[F.col(f"`{start + i}`").alias(n) for i, n in enumerate(names)])
        yield names, every.join(named, "entity_key", "left")


def name_entities(wide: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """Put the registry's spelling of the entity in front; unknown entities keep their key."""
    known = registry.filter(F.col(column).isNotNull()).groupBy(id_key(F.col(column)).alias("entity_key")).agg(F.min(column).alias("_name"))
    rest = [c for c in wide.columns if c != "entity_key"]
    return wide.join(known, "entity_key", "left").select(F.coalesce("_name", "entity_key").alias(column), *[F.col(f"`{c}`") for c in rest])


def competing_cells(named: DataFrame, entity: str, attribute: str) -> DataFrame:
    """The cells of the wide table whose values disagree."""
    return named.select(entity, F.explode("competing").alias(attribute))
