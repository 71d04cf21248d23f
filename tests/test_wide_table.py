import pytest

from helixmill.errors import PreprocessingError
from helixmill.operators import wide_table as w

SCHEMA = "s string, g string, v double, t int, entity_key string, value double, competing string"


def wide(spark, rows, attributes=("G1", "G2", "G3"), **options):
    df = spark.createDataFrame([(*r, "x", 0.0, "y") for r in rows], SCHEMA)
    spec = w.WideSpec("s", "g", "v", list(attributes), order=("t",), **options)
    out = w.to_wide(df, spec)
    return {r["entity_key"]: r for r in out.collect()}, out


def test_cells_spelling_and_competing_values(spark):
    got, _ = wide(spark, [("a-1", "g1", 1.0, 1), ("A 1", " G1.7", 2.0, 2), ("a1", "G2", 5.0, 1), ("A.1", "G2.3", 5.0005, 2)])
    assert set(got) == {"A1"} and got["A1"]["G1"] == 2.0 and got["A1"]["G3"] is None and got["A1"]["competing"] == ["G1"]


def test_what_is_no_value(spark):
    got, _ = wide(spark, [("a", "G1", None, 1), ("a", "G2", float("nan"), 1), ("a", "G3", -1.0, 1), ("b", "G1", 3.0, 1), ("b", "G1", -5.0, 2), ("b", "G1", None, 3)])
    assert [got["A"][g] for g in ("G1", "G2", "G3")] == [None] * 3 and got["B"]["G1"] == 3.0 and got["B"]["competing"] == []


def test_ties_repeats_unknown_and_blank(spark):
    got, _ = wide(spark, [("a", "G1", 4.0, 1), ("a", "G1", 2.0, 1), ("a", "G1", 2.0, 1), ("a", "zz", 1.0, 1), ("", "G1", 1.0, 1), (None, "G1", 1.0, 1), ("b", None, 1.0, 1), ("c", "--", 1.0, 1)])
    assert set(got) == {"A"} and got["A"]["G1"] == 2.0 and got["A"]["competing"] == ["G1"]


def test_empty_table_keeps_its_columns(spark):
    got, df = wide(spark, [])
    assert got == {} and df.columns == ["entity_key", "G1", "G2", "G3", "competing"]


def test_frequent_signatures_make_the_same_table(spark):
    rows = [(f"e{i}", g, float(i + k), 1) for i in range(30) for k, g in enumerate(["G1", "G2"] if i % 3 else ["G1", "G3"])] + [("lone", "G2", 1.0, 1)]
    one, _ = wide(spark, rows)
    many, _ = wide(spark, rows, min_support=5, max_tables=4)
    assert {k: tuple(v) for k, v in one.items()} == {k: tuple(v) for k, v in many.items()}
    spec = w.WideSpec("s", "g", "v", ["G1", "G2", "G3"], order=("t",), min_support=5)
    entity = w.entities(w.cells(spark.createDataFrame([(*r, "x", 0.0, "y") for r in rows], SCHEMA), spec))
    assert w.frequent_signatures(entity, spec) == [[0, 1], [0, 2]]
    assert w.signature_report(entity).first().asDict() == {"n_signatures": 3, "n_entities": 31, "largest": 20, "most_attributes": 2}


def test_named_entities_and_attribute_limit(spark):
    got, df = wide(spark, [("a-1", "G1", 1.0, 1), ("zz", "G1", 1.0, 1)])
    registry = spark.createDataFrame([("A-1", 1), ("A-1", 2), (None, 3)], "s string, n int")
    named = {r["s"]: r["G1"] for r in w.name_entities(df, registry, "s").collect()}
    assert named == {"A-1": 1.0, "ZZ": 1.0}
    with pytest.raises(PreprocessingError):
        w.attribute_names(spark.range(20).selectExpr("cast(id as string) as n"), "n", 10)


def test_blocks_hold_what_the_wide_table_holds(spark):
    rows = [(f"e{i % 7}", f"G{(i * i) % 11}", float(i), i) for i in range(60)] + [("none", "G99", 1.0, 1), ("gap", "G1", None, 1)]
    names = [f"G{i}" for i in range(11)]
    got, _ = wide(spark, rows, names)
    df = spark.createDataFrame([(*r, "x", 0.0, "y") for r in rows], SCHEMA)
    blocks = list(w.wide_blocks(df, w.WideSpec("s", "g", "v", names, order=("t",), max_attributes=3), width=4))
    assert [len(n) for n, _ in blocks] == [4, 4, 3]
    for n, block in blocks:
        assert {r["entity_key"]: tuple(r[c] for c in n) for r in block.collect()} == {k: tuple(r[c] for c in n) for k, r in got.items()}
