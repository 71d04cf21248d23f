"""Registered queries answer for all ids, columns and rows, not for a fixed part of them."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from helixmill.operators import quality
from helixmill.plans import align_queries, export_queries, learn_queries, matrix_queries


def stored(df, root, name):
    df.write.parquet(f"{root}/{name}.parquet")


def test_patients_and_barcodes_of_all_keys_are_matched(spark, tmp_path):
    keys = [1, 105, 1105, 4999, 5000, 9999, 10_001, 15_000, 150_001, 12_959_999, 12_960_000, 1_500_000_000]
    stored(spark.createDataFrame([(k,) for k in keys + [20_105]], "c_custkey long"), tmp_path, "customer")
    stored(spark.createDataFrame([(k, "F") for k in keys if k != 105] + [(105, "O"), (30_105, "F"), (1, "F")], "o_custkey long, o_orderstatus string"), tmp_path, "orders")
    patients = [r["id"] for r in align_queries.match_patient_id(spark, str(tmp_path)).collect()]
    barcodes = [r["id"] for r in align_queries.match_barcode(spark, str(tmp_path)).collect()]
    assert len(patients) == len(set(patients)) == len(keys) - 1 and {"TCGA-8A-0001", "TCGA-8A-5000", "TCGA-8B-0001"} <= set(patients)
    assert sorted(barcodes) == sorted(f"{p}-01" for p in patients)


def test_patient_ids_do_not_collide(spark):
    ids = spark.range(100_000).union(spark.range(12_900_000, 13_000_000)).union(spark.range(1_584_000_000, 1_584_100_000)).select(align_queries._patient("id").alias("p"))
    assert ids.distinct().count() == 300_000 and ids.filter(F.col("p").rlike("^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}$")).count() == 300_000


def test_all_samples_are_transposed(spark, tmp_path):
    stored(spark.createDataFrame([(1, "Brand#1"), (2, "Brand#25")], "p_partkey long, p_brand string"), tmp_path, "part")
    stored(spark.createDataFrame([(1, 1, 2.0), (9, 2, 3.0), (10, 1, 4.0), (10, 1, 1.0), (5000, 2, 6.0)], "l_suppkey long, l_partkey long, l_quantity double"), tmp_path, "lineitem")
    turned = matrix_queries.transpose_matrix(spark, str(tmp_path))
    rows = {(r["feature"], r["sample"]): r["value"] for r in turned.collect()}
    assert turned.columns == ["feature", "sample", "value"] and len(rows) == turned.count() == 25 * 4
    assert {k: v for k, v in rows.items() if v is not None} == {("Brand#1", 1): 2.0, ("Brand#25", 9): 3.0, ("Brand#1", 10): 5.0, ("Brand#25", 5000): 6.0}


def test_all_cases_are_in_the_counts_matrix(spark, tmp_path):
    stored(spark.createDataFrame([(i, 7, float(i)) for i in range(1, 8)] + [(5, 8, 2.0), (5, 8, 4.0)], "l_linenumber int, l_partkey long, l_quantity double"), tmp_path, "lineitem")
    rows = {r["gene_id"]: list(r)[1:] for r in export_queries.counts_matrix(spark, str(tmp_path)).collect()}
    assert rows == {7: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 8: [0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0]}


def test_normality_of_large_features(spark):
    inverse = NormalDist().inv_cdf
    columns = {"normal": lambda u: round(inverse(u), 2), "even": lambda u: u, "flat": lambda u: 3.0}
    rows = [(f, v((i + 0.5) / 6000)) for f, v in columns.items() for i in range(6000)] + [("few", float(i * i)) for i in range(9)] + [("two", 1.0), ("two", 2.0)]
    found = {r["feature"]: r for r in quality.normality(spark.createDataFrame(rows, "feature string, value double")).collect()}
    assert {f: (r["n"], r["test"]) for f, r in found.items()} == {f: (6000, "anderson_darling") for f in columns} | {"few": (9, "shapiro_wilk")}
    assert found["normal"]["p_value"] > 0.9 and found["even"]["p_value"] < 1e-9 and (found["flat"]["w"], found["flat"]["p_value"]) == (0.0, 1.0)
    x = sorted(v for f, v in rows if f == "even")
    norm = NormalDist.from_samples(x)
    a = -len(x) - sum((2 * i + 1) * (math.log(norm.cdf(x[i])) + math.log(1 - norm.cdf(x[-1 - i]))) for i in range(len(x))) / len(x)
    assert found["even"]["w"] == pytest.approx(a * (1 + 0.75 / 6000 + 2.25 / 6000**2), rel=1e-6)


def test_all_numbers_of_a_vector_are_learnt_from_and_exported(spark, tmp_path):
    rows = [(i, i % 3 % 2, [1.0] * 16 + [float(i % 3 % 2)] * 47 + [float(i)]) for i in range(300)]
    stored(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), tmp_path, "embeddings")
    for query in (learn_queries.rf_confusion, learn_queries.logistic_confusion):
        assert all(r["label"] == r["prediction"] for r in query(spark, str(tmp_path)).collect())
    assert {r["f1"] for r in learn_queries.rf_class_report(spark, str(tmp_path)).collect()} == {1.0}
    out = {r["sample"]: r for r in export_queries.ml_export(spark, str(tmp_path)).collect()}
    assert len(out) == 300 and list(out[7])[3:] == rows[7][2]


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
