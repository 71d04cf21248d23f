import json

import pytest
from pyspark.sql import functions as F

from helixmill import bundle, cli, reports
from helixmill.config import Config
from helixmill.errors import ConfigurationError, ExportError, SampleAlignmentError, ValidationError
from helixmill.functions import extend, ids
from helixmill.operators import align, fuse, fuzzy, impute, mapping, validate
from helixmill.sources import exports, fhir, readers
from helixmill.streaming import transforms


@pytest.mark.parametrize(
    ("raw", "patient"),
    [("TCGA-AB-1234-01A-11R-A123-07", "TCGA-AB-1234"), ("tcga-ab-12x4", "TCGA-AB-12X4"), ("P001", "P001"), ("SAMPLE123", "PLE123"), (" x 12345 ", "12345"), ("ab-12", "AB-12"), ("none", "none"), ("", None), (None, None)],
)
def test_patient_ids(spark, raw, patient):
    assert spark.createDataFrame([(raw,)], "x string").select(ids.patient_id(F.col("x")).alias("p")).first()["p"] == patient


def test_other_ids(spark):
    df = spark.createDataFrame([("TCGA-AB-1234-01A-11R",), ("P1",), ("a b/" + "c" * 60,)], "x string")
    assert [r["b"] for r in df.select(ids.barcode(F.col("x")).alias("b")).collect()] == ["TCGA-AB-1234-01", None, None]
    got = [r["s"] for r in df.select(ids.standard_id("geo", F.col("x")).alias("s")).collect()]
    assert got[1].startswith("GEO_P1_") and len(got[2]) == 50 and got[2][42:] == got[2][42:].lower()
    assert ids.sample_column(df.withColumnRenamed("x", "Sample_ID")) == "Sample_ID" and ids.sample_column(df.withColumnRenamed("x", "my patient")) == "my patient" and ids.sample_column(df) == "x"


def tables(spark):
    return {
        "a": spark.createDataFrame([("s1", 1.0), ("s2", 3.0), ("s3", 5.0), (None, 9.0)], "id string, x double"),
        "b": spark.createDataFrame([("s2", 2.0, 7), ("s3", None, 7), ("s4", 4.0, 7)], "id string, y double, c int"),
    }


def test_alignment(spark):
    t = tables(spark)
    assert {r["id"] for r in align.common_ids(t, "id").collect()} == {"s2", "s3"}
    assert {n: x.count() for n, x in align.align(t, "id").items()} == {"a": 2, "b": 2}
    got = {(r["a"], r["b"]): r["jaccard"] for r in align.overlap(t, "id").collect()}
    assert got["a", "b"] == 0.5 and got["a", "a"] == 3.0
    with pytest.raises(SampleAlignmentError):
        align.common_ids(t, "nothing")
    both = align.align_by_patient({"m": spark.createDataFrame([("TCGA-AA-1111-01A",), ("TCGA-AA-2222-01A",)], "sample_id string"), "c": spark.createDataFrame([("tcga-aa-1111",)], "patient_id string")}, {})
    assert [r["patient_key"] for r in both["m"].collect()] == ["TCGA-AA-1111"]


def test_one_to_one_mapping(spark):
    a = spark.createDataFrame([("A-1",), ("B-2",), ("C_3",), ("d",), ("D",)], "x string")
    b = spark.createDataFrame([("A-1",), ("b-2",), ("C3",), ("d",), ("zz",)], "y string")
    m = align.validate_mapping(a, b, "x", "y")
    assert {(r["id_a"], r["id_b"], r["how"]) for r in m.collect()} == {("A-1", "A-1", "exact"), ("d", "d", "exact"), ("B-2", "b-2", "case"), ("C_3", "C3", "punctuation")}
    assert align.mapping_score(m, a, b, "x", "y").first()["valid"]


def test_fuzzy_pairs_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(120)} | {"alpha beta", "alpha bets", "alpah beta", "a", "b"})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    for t in (0.8, 0.9):
        got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", t).collect()}
        assert got == {(x, y) for x in words for y in words if SequenceMatcher(None, x, y).ratio() >= t}
    best = {r["a"]: r["b"] for r in fuzzy.best_matches(spark.createDataFrame([("alpha betz",), ("a",), ("zzzzzz",)], "a string"), df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert best == {"alpha betz": "alpha beta", "a": "a"}
    groups = {r["w"]: r["representative"] for r in fuzzy.groups(spark.createDataFrame([("alpha beta",), ("alpha bets",), ("gamma",)], "w string"), "w").collect()}
    assert groups == {"alpha beta": "alpha beta", "alpha bets": "alpha beta", "gamma": "gamma"}


def test_fusion(spark):
    t = tables(spark)
    early = {r["id"]: r for r in fuse.early(t, "id").collect()}
    assert set(early) == {"s2", "s3"} and early["s2"]["a_x"] == -1.0 and early["s2"]["b_c"] == 0.0 and early["s3"]["b_y"] is None
    merged = fuse.merge({"none": spark.range(1).withColumnRenamed("id", "z"), **t, "far": t["a"].filter("id = 's1'")}, "id")
    assert merged.columns == ["id", "x", "b_y", "b_c"] and merged.count() == 2
    assert fuse.late(t, "id")["integrated"].count() == 2 and fuse.integrate(t, "id", ("early",))["early"].count() == 2
    assert fuse.integrate(t, "missing", ("late",))["late"]["status"] == "failed"
    b = bundle.OmicsTables(t, "id").impute("mean").align().scale("minmax")
    assert not b.problems and b.fuse("early").count() == 2 and b.quality().count() == 2
    assert bundle.OmicsTables(t, "id").map(lambda n, x: x.select("nope") if n == "a" else x).problems.keys() == {"a"}


def test_mapping(spark):
    genes = spark.createDataFrame([("E1", "1", "Abc"), ("E2", "2", "DEF"), ("E2", "3", "GHI"), ("E3", None, "")], "ensembl string, entrez string, symbol string")
    df = spark.createDataFrame([("abc",), ("zzz",), (None,)], "g string")
    assert [r["entrez_id"] for r in mapping.map_ids(df, "g", genes, "symbol", "entrez").collect()] == ["1"]
    assert {r["from_id"]: r["to_id"] for r in mapping.lookup(genes, "ensembl", "symbol").collect()} == {"E1": "Abc", "E2": "DEF"}
    s = mapping.mapping_stats(df, "g", genes, "symbol", "entrez").first()
    assert (s["n_ids"], s["n_mapped"], s["mapped_percent"]) == (2, 1, 50.0)


def test_validation(spark):
    df = spark.createDataFrame([("s", "g", -1.0, "+"), (None, "g", 2.0, "?")], "sample_id string, gene_id string, expression_value double, strand string")
    got = {(r["column_name"], r["check"]): r["n_failed"] for r in validate.violations(df, validate.SCHEMAS["gene_expression"], {"big": F.col("expression_value") > 1}).collect()}
    assert got["sample_id", "null"] == got["expression_value", "range"] == got["strand", "allowed"] == got["big", "custom"] == 1
    assert validate.detect_schema("x", df.columns) == "gene_expression" and validate.detect_schema("my_proteins protein", []) == "proteomics"
    for bad, columns in ((df, ["nope"]), (df.limit(0), ["gene_id"]), (df.withColumn("e", F.lit(None).cast("int")), ["e"])):
        with pytest.raises(ValidationError):
            validate.require(bad, columns)


def test_readers(spark, tmp_path):
    import gzip

    (tmp_path / "c").mkdir()
    with gzip.open(tmp_path / "c" / "case1.htseq.counts.gz", "wt") as f:
        f.write("G1\t5\nG2\tx\n__ambiguous\t9\nG3\t1\t2\nG4\t0\n")
    (tmp_path / "c" / "case2.txt").write_text("G1\t7\n")
    counts = readers.read_counts(spark, str(tmp_path / "c"))
    assert {(r["case_id"], r["gene_id"]): r["count"] for r in counts.collect()} == {("case1", "G1"): 5.0, ("case1", "G4"): 0.0, ("case2", "G1"): 7.0}
    assert {r["gene_id"]: (r["case1"], r["case2"]) for r in readers.counts_matrix(counts, ["case1", "case2"]).collect()} == {"G1": (5.0, 7.0), "G4": (0.0, 0.0)}
    (tmp_path / "x.json").write_text(json.dumps([{"case_id": "a", "demographic": {"gender": "male", "age_at_index": 50}, "diagnoses": []}, {"case_id": "b", "diagnoses": [{"tumor_grade": "G1"}, {"tumor_grade": "G2"}]}]))
    flat = {r["case_id"]: r for r in readers.read_clinical(spark, str(tmp_path / "x.json")).collect()}
    assert flat["a"]["gender"] == "male" and flat["a"]["tumor_grade"] is None and flat["b"]["tumor_grade"] == "G1"
    (tmp_path / "s.soft").write_text("!head = 1\n^SAMPLE = S1\n!k = a\n!k = b\n# note\n1\t2\n^SAMPLE = S2\n!k = c\n")
    got = {(r["entity_id"], r["key"]): r["values"] for r in readers.read_entities(spark, str(tmp_path / "s.soft")).collect()}
    assert got == {(None, "head"): ["1"], ("S1", "k"): ["a", "b"], ("S1", None): ["1\t2"], ("S2", "k"): ["c"]}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 3), ("b\t\"c\"", float("nan"), None)], "name string, v double, n int")
    path = exports.write_csv(df, str(tmp_path / "one"), sep="\t", metadata={"study": "x"}, run_at="now", files=1)
    lines = exports.read_text(spark, path + "/*.txt").split("\n")
    assert lines[:2] == ["# study: x", "# export date: now"] and lines[4] == "name\tv\tn"
    assert {tuple(r) for r in readers.read_csv(spark, path, "name string, v double, n int", "\t", "#").collect()} == {("a", 1.5, 3), ('b\t"c"', None, None)}
    assert [json.loads(r[0]) for r in exports.json_lines(df).collect()] == [{"name": "a", "v": 1.5, "n": 3}, {"name": 'b\t"c"', "v": None, "n": None}]
    document = exports.json_document(df, {"by": "t"}, "now")
    assert exports.valid_envelope(document) == [] and json.loads(document)["metadata"]["n_samples"] == 2 and exports.valid_envelope("[") and exports.valid_envelope("{}")
    schema = json.loads(exports.json_schema_text(df))["items"]
    assert schema["required"] == ["name", "v"] and schema["properties"]["n"] == {"type": ["integer", "null"]}
    assert dict(exports.narrow(df).dtypes)["n"] == "tinyint"
    with pytest.raises(ExportError):
        exports.write_parquet(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ExportError):
        exports.write_csv_validated(df.limit(0), str(tmp_path / "none"))
    assert exports.write_csv_validated(df, str(tmp_path / "two"), {"v": (0, 1)}) == ["v: 2 values outside their range"]
    sizes = exports.parquet_summary(df, str(tmp_path / "sizes"), ["snappy", "gzip"])
    assert [s["compression"] for s in sizes] == ["snappy", "gzip"] and all(s["bytes"] > 0 for s in sizes)
    about = exports.write_learning_set(df.withColumn("split", F.lit("train")), str(tmp_path / "ml"), "name", "n")
    assert about["features"] == ["v"] and about["rows"] == {"train": 2}
    assert json.loads(exports.api_envelope(df))["count"] == 2


def test_health_records(spark):
    df = spark.createDataFrame([("p1", "F", 50.0, "II", 12.5, None), ("p2", None, None, None, 1.0, 3)], "id string, gender string, age double, tumor_stage string, gene_expression_TP53 double, lymph_nodes int")
    e = fhir.entries(df, "id", 2024, "2024-01-01")
    assert {r["resource_type"]: r["n"] for r in fhir.resource_counts(e).collect()} == {"Patient": 2, "Observation": 5, "DiagnosticReport": 2, "Specimen": 2}
    document = fhir.bundle(e, "2024-01-01")
    assert fhir.validate_bundle(document) == [] and fhir.validate_bundle("{}") and fhir.validate(e).filter("n_missing > 0").count() == 0
    first = json.loads(document)["entry"][0]["resource"]
    assert (first["resourceType"], first["gender"], first["birthDate"]) == ("Patient", "female", "1974-01-01")


def test_configuration(tmp_path):
    c = Config()
    assert c.get("preprocessing.imputation.k") == 5 and c.get("no.such", 1) == 1
    assert c.update("preprocessing.imputation.method", "mean").get("preprocessing.imputation.method") == "mean" and c.get("preprocessing.imputation.method") == "knn"
    for path, value in (("preprocessing.imputation.method", "magic"), ("export.test_size", 2), ("integration.scaling", "odd"), ("export.format", "xls")):
        with pytest.raises(ConfigurationError):
            c.update(path, value)
    (tmp_path / "c.yaml").write_text("preprocessing: {imputation: {k: 7}}")
    assert Config.from_yaml(str(tmp_path / "c.yaml")).get("preprocessing.imputation.k") == 7
    with pytest.raises(ConfigurationError):
        Config.from_yaml(str(tmp_path / "none.yaml"))


def test_extensions_and_streams(spark, tmp_path):
    assert extend.by_chunk(spark.range(25), lambda p: p.assign(n=len(p)), "id long, n long", 10).agg(F.max("n")).first()[0] <= 10
    assert extend.by_item(spark, lambda x: str(1 / int(x)), ["1", "0", "2"]) == ["1.0", None, "0.5"]
    cache = extend.ResultCache(1)
    assert [cache.get(k, lambda k=k: k * 2) for k in ("a", "b", "a")] == ["aa", "bb", "aa"] and extend.efficiency_score(90, 65, 10) == 73
    batch = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k int, x double")
    batch.write.parquet(str(tmp_path / "in"))
    fills = impute.fit_simple(batch, "mean", ["x"], texts=[])
    stream = transforms.apply(transforms.read_tables(spark, str(tmp_path / "in"), "k int, x double"), [fills])
    transforms.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert {r["k"]: r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 2.0, 2: 3.0, 3: 4.0}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "o.csv").write_text("patient_id,g\np1,1\np2,\np3,7\n")
    (tmp_path / "c.csv").write_text("patient_id,age,stage\np1,50,I\np2,,II\n")
    args = ["--omic", str(tmp_path / "o.csv"), "--clinical", str(tmp_path / "c.csv"), "--output", str(tmp_path / "out"), "--format", "parquet"]
    assert cli.main(args) == 0 and json.loads(capsys.readouterr().out.strip().split("\n")[-1])["n_samples"] == 2
    assert spark.read.parquet(str(tmp_path / "out")).filter("g is null or age is null").count() == 0


def test_reports(spark, tmp_path):
    t = tables(spark)
    text = reports.alignment_text(t, "id")
    assert "a: 2 of 3 samples matched (66.7 %)" in text and "a and b: 2 common samples" in text
    assert "x (double): 0.0 % missing" in reports.data_text(t["a"]) and "y (double): 33.3 % missing" in reports.data_text(t["b"])
    rows = reports.integration_summary(fuse.integrate(t, "id", ("early", "late")) | {"bad": {"status": "failed"}})
    assert [(r["method"], r["status"], r["n_samples"]) for r in rows] == [("early", "success", 2), ("late", "success", 2), ("bad", "failed", 0)]
    reports.set_up_logging(str(tmp_path / "log"), as_json=True).info("done")
    assert json.loads((tmp_path / "log").read_text())["message"] == "done"


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
