import math

import pytest
from pyspark.sql import functions as F

from helixmill.errors import MissingDataError, PreprocessingError
from helixmill.functions import special
from helixmill.operators import impute, learn, matrix, normalize, quality, reduce
from helixmill.plans import pipeline

NAN = float("nan")


def long(spark, columns, extra=""):
    """{feature: [values]} as (sample, feature, value)."""
    rows = [(i, f, v) for f, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "sample int, feature string, value double")


def cells(df):
    return {(r["sample"], r["feature"]): r["value"] for r in df.collect()}


def test_wide_and_long_are_inverse(spark):
    wide = spark.createDataFrame([("a", 1, 2.0, NAN, "x"), ("b", None, None, 4.0, "y")], "k string, `p.1` int, q double, r double, t string")
    assert matrix.numeric_columns(wide, ["k"]) == ["p.1", "q", "r"] and matrix.categorical_columns(wide, ["k"]) == ["t"]
    tall = matrix.to_long(wide, "k")
    assert {(r["k"], r["feature"]): r["value"] for r in tall.collect()} == {("a", "p.1"): 1.0, ("a", "q"): 2.0, ("a", "r"): None, ("b", "p.1"): None, ("b", "q"): None, ("b", "r"): 4.0}
    assert matrix.to_long(wide, "k", []).collect() == [] and matrix.to_long(wide, "k", []).columns == tall.columns
    back = matrix.to_wide(tall, "k", "feature", "value", ["q", "r"], fill=0.0)
    assert {r["k"]: (r["q"], r["r"]) for r in back.collect()} == {"a": (2.0, 0.0), "b": (0.0, 4.0)}
    turned = matrix.transpose(wide, "k", ["q", "r"], ["a", "b"])
    assert {r["feature"]: (r["a"], r["b"]) for r in turned.collect()} == {"q": (2.0, None), "r": (None, 4.0)}


def test_scaling_of_constant_missing_and_ordinary_features(spark):
    df = long(spark, {"flat": [3.0, 3.0, 3.0], "gap": [1.0, None, 3.0], "x": [0.0, 5.0, 10.0]})
    z = cells(normalize.standard(df))
    assert [z[i, "flat"] for i in range(3)] == [0.0] * 3 and z[1, "gap"] is None and z[0, "gap"] == -1.0
    assert z[0, "x"] == pytest.approx(-math.sqrt(1.5))
    assert cells(normalize.minmax(df))[1, "x"] == 0.5 and cells(normalize.minmax(df, -1, 1))[2, "x"] == 1.0
    assert cells(normalize.robust(df))[2, "x"] == 1.0 and cells(normalize.center_median(df))[0, "x"] == -5.0
    assert cells(normalize.pareto(df))[2, "x"] == pytest.approx(5 / math.sqrt(5.0))
    logs = cells(normalize.log_transform(long(spark, {"n": [-4.0, 3.0, None]})))
    assert (logs[0, "n"], logs[1, "n"], logs[2, "n"]) == (0.0, 2.0, None)
    assert cells(normalize.log2_zscore(df))[0, "flat"] == 2.0


def test_expression_normalisation(spark):
    df = long(spark, {"g1": [10.0, 0.0], "g2": [30.0, 0.0]})
    lengths = spark.createDataFrame([("g1", 1000.0), ("g2", 3000.0)], "feature string, length double")
    assert {k: v for k, v in cells(normalize.tpm(df, lengths)).items() if k[0] == 0} == {(0, "g1"): pytest.approx(5e5), (0, "g2"): pytest.approx(5e5)}
    assert cells(normalize.tpm(df, lengths))[1, "g1"] == 0.0 and cells(normalize.fpkm(df, lengths))[0, "g1"] == pytest.approx(250_000)
    assert {r["sample"]: r["size_factor"] for r in normalize.size_factors(long(spark, {"g": [0.0, 8.0]})).collect()} == {0: 1.0, 1: pytest.approx(8 / 3)}


def test_quantile_normalisation_shares_one_distribution(spark):
    df = long(spark, {"a": [5.0, 4.0], "b": [2.0, 1.0], "c": [3.0, 4.0], "d": [4.0, 2.0]})
    got = cells(normalize.quantile_normalize(df))
    assert sorted(got[0, f] for f in "abcd") == [1.5, 2.5, 4.0, 4.5]
    # the tie of 4 and 4 takes the rank below 3.5
    assert got[1, "a"] == got[1, "c"] == 4.0


def test_dispatch(spark):
    with pytest.raises(PreprocessingError):
        normalize.normalize(long(spark, {"a": [1.0]}), "clinical", "tpm")
    assert cells(normalize.normalize(long(spark, {"a": [1.0, 3.0]}), "proteomics"))[0, "a"] == -1.0
    factors = {r["sample"]: r["factor"] for r in normalize.trimmed_mean_factors(long(spark, {f"g{i}": [float(i + 1), 2.0 * (i + 1)] for i in range(30)})).collect()}
    assert factors == {0: pytest.approx(1.0), 1: pytest.approx(1.0)}


def test_simple_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "b", None), (2, NAN, "a", None), (3, 4.0, None, None), (4, 9.0, "a", None), (5, 2.0, "b", None)], "k int, x double, t string, u string")
    fills = impute.fit_simple(df, "median", exclude=["k"])
    assert (fills.numbers, fills.texts) == ({"x": 3.0}, {"t": "a", "u": "Unknown"})
    once = fills.transform(df)
    assert once.collect() == fills.transform(once).collect() and once.filter("x is null or isnan(x) or t is null or u is null").count() == 0
    assert impute.fit_simple(df, "mean", ["x"], texts=[]).numbers == {"x": 4.0} and impute.fit_simple(df, "constant", ["x"], constant=7, texts=[]).numbers == {"x": 7.0}
    assert impute.fit_simple(df.union(df.filter("k = 4")), "most_frequent", ["x"], texts=[]).numbers == {"x": 9.0}
    with pytest.raises(PreprocessingError):
        impute.impute(df, "magic")
    assert impute.fit_simple(df.limit(0), "median", exclude=["k"]).numbers == {"x": None}


def test_column_filters(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, 1.0, 2.0)], "k int, a double, b double")
    assert impute.drop_sparse(df, 0.5, ["k"]).columns == ["k", "b"]
    with pytest.raises(MissingDataError):
        impute.guard_missing(df, 0.3, ["k"])
    assert impute.guard_missing(df, 0.5, ["k"]).columns == ["k", "b"]


def test_nearest_neighbour_imputation(spark):
    rows = [(1, 1.0, 1.0, "A"), (2, 2.0, None, "B"), (3, None, 3.0, None), (4, 4.0, 4.0, "A"), (5, 5.0, 5.0, "B"), (6, None, None, "A")]
    df = spark.createDataFrame(rows, "k int, x double, y double, t string")
    full = {r["k"]: r for r in impute.impute(df, "knn", key="k", k=2).collect()}
    assert full[2]["y"] == 2.5 and full[3]["x"] == 2.5 and full[3]["t"] == "A"
    # nothing in common with anybody: the mean of the column
    assert full[6]["x"] == 3.0 and full[6]["y"] == 3.25
    exact = spark.createDataFrame([(1, 1.0, 10.0), (2, 1.0, 20.0), (3, 2.0, 99.0), (4, 1.0, None)], "k int, x double, y double")
    got = {r["k"]: r["y"] for r in impute.impute(exact, "knn_distance", key="k", k=3).collect()}
    assert got[4] == 15.0


def test_neighbours_in_blocks_are_the_same(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(i, *[None if rng.random() < 0.2 else rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double").repartition(5)
    key = lambda d: sorted((r["key"], r["feature"], r["donor"]) for r in d.collect())
    one = key(impute.nearest_donors(df, "k", ["a", "b", "c", "d"], 3))
    monkeypatch.setattr(impute, "QUERY_BLOCK", 20)
    assert key(impute.nearest_donors(df, "k", ["a", "b", "c", "d"], 3)) == one


def test_missing_reports(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1.0, None), (3, 1.0, "a"), (4, None, None)], "k int, x double, t string")
    assert {r["column_name"]: r["missing_percent"] for r in quality.missing_report(df, ["k", "x", "t"]).collect()} == {"x": 50.0, "t": 50.0}
    s = quality.missing_summary(df, ["k", "x", "t"]).first()
    assert (s["n_cells"], s["n_missing"], s["rows_with_missing"], s["complete_percent"]) == (12, 4, 3, 25.0)
    assert [(r["n_missing"], r["n_rows"]) for r in quality.missing_patterns(df, ["x", "t"]).collect()] == [(1, 2), (0, 1), (2, 1)]
    assert quality.missing_summary(df.limit(0), ["x"]).first()["n_missing"] == 0


def test_outliers_and_correlations(spark):
    df = long(spark, {"x": [1.0, 2.0, 3.0, 2.0, 100.0, None], "y": [2.0, 4.0, 6.0, 4.0, 200.0, 1.0]})
    assert [r["sample"] for r in quality.outliers(df).collect()] == [4]
    assert quality.outliers(df, "zscore").count() == 0
    with pytest.raises(Exception, match="unknown outlier"):
        quality.outliers(df, "none")
    r = quality.correlations(df).first()
    assert (r["feature_a"], r["feature_b"], r["n"]) == ("x", "y", 5) and r["r"] == pytest.approx(1.0)
    assert quality.correlation_summary(quality.correlations(df)).first()["n_high"] == 1


def test_statistics_against_known_values(spark):
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6) and special.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.001)
    rows = [(i, "f", v, g) for i, (g, v) in enumerate([("a", 27.0), ("a", 2.0), ("a", 4.0), ("a", 18.0), ("a", 7.0), ("a", 9.0), ("b", 20.0), ("b", 8.0), ("b", 14.0), ("b", 36.0), ("b", 21.0), ("b", 22.0), ("c", 34.0), ("c", 31.0), ("c", 3.0), ("c", 23.0), ("c", 30.0), ("c", 6.0)])]
    df = spark.createDataFrame(rows, "sample int, feature string, value double, g string")
    k = quality.kruskal(df, "g").first()
    assert k["h"] == pytest.approx(2.854, abs=1e-3) and k["p_value"] == pytest.approx(0.24, abs=1e-3)
    t = quality.two_groups(df, "g", "a", "b").first()
    assert t["t"] == pytest.approx(-1.647, abs=1e-3) and 0 < t["p_value"] < 1
    assert quality.mann_whitney(df, "g", "a", "b").first()["u"] == 8.0


def test_principal_components(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        a, b = rng.gauss(0, 3), rng.gauss(0, 1)
        rows.append((i, a + b, a - b, rng.gauss(0, 0.1), None if i == 7 else 1.0))
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, flat double")
    cols = ["x", "y", "z", "flat"]
    p = reduce.pca(df, "k", cols, 3)
    assert p.ratios[0] > 0.8 and (p.loadings.T @ p.loadings == pytest.approx(__import__("numpy").eye(3), abs=1e-9))
    scores = p.scores.toPandas()
    assert abs(scores["PC1"].mean()) < 1e-9 and abs(scores["PC1"].corr(scores["PC2"])) < 1e-9 and scores["PC1"].std() > scores["PC2"].std()
    top = {(r["component"], r["rank"]): r["feature"] for r in reduce.top_loadings(reduce.loading_rows(spark, p), 2).collect()}
    assert {top[1, 1], top[1, 2]} == {"x", "y"}
    _, r2 = reduce.pls(df.withColumn("t", F.col("x") * 2 - F.col("z")), "k", cols, "t", 3)
    assert r2 > 0.99
    losses = reduce.nmf(df, "k", ["x", "y", "z"], 2, rounds=6).losses
    assert losses[-1] < losses[0] and all(b <= a * 1.001 for a, b in zip(losses, losses[1:]))
    s = reduce.ica(df, "k", ["x", "y"], 2, rounds=15).scores.toPandas()
    assert abs(s["IC1"].corr(s["IC2"])) < 0.05


def test_learning(spark):
    import random

    rng = random.Random(6)
    rows = [(i, i % 2, (i % 2) * 3 + rng.gauss(0, 1), rng.gauss(0, 1), 50.0 if i == 11 else rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, label int, good double, bad double, odd double")
    tall = matrix.to_long(df.select("k", "good", "bad"), "k").join(df.select("k", "label"), "k")
    assert learn.top_features(learn.anova_f(tall, "label"), "f", 1).first()["feature"] == "good"
    mi = {r["feature"]: r["mi"] for r in learn.binned_information(tall, "label").collect()}
    assert mi["good"] > 0.3 > 0.1 > mi["bad"] >= 0
    split = learn.stratified_split(df, "k", "label", 0.25)
    counts = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts[0, "test"] == counts[1, "test"] == 50
    c = learn.confusion(learn.evaluate(split, ["good", "bad"], "label", "logistic")[0])
    report = {r["label"]: r["f1"] for r in learn.class_report(c).collect()}
    assert min(report.values()) > 0.8
    scores = learn.isolation_scores(df, "k", ["good", "bad", "odd"], trees=30)
    assert scores.orderBy(F.desc("score")).first()["k"] == 11
    assert learn.isolation_outliers(scores, 0.05).count() == 20


def test_pipeline_against_hand_computation(spark):
    omic = spark.createDataFrame([("p1", 1.0, 3.0), ("p2", None, 7.0), ("p3", 7.0, 3.0), ("p9", 3.0, 3.0)], "id string, g double, h double")
    clinical = spark.createDataFrame([("p1", 50.0, "I"), ("p2", None, None), ("p3", 60.0, "II"), ("p4", 70.0, "I")], "id string, age double, stage string")
    out = {r["id"]: r for r in pipeline.run(omic, clinical, "id").collect()}
    assert set(out) == {"p1", "p2", "p3"} and out["p2"]["age"] == 60.0 and out["p2"]["stage"] == "I"
    # log2(x + 1) of g is 1, 2, 3, 2: mean 2, deviation root of 2/3
    assert out["p1"]["g"] == pytest.approx(-1 / math.sqrt(2 / 3)) and out["p2"]["g"] == 0.0
    result = pipeline.run_checked(omic, clinical, "id")
    assert (result["status"], result["n_samples"], result["n_features"], result["completeness_percent"]) == ("success", 3, 4, 100.0)
    assert pipeline.run_checked(omic, clinical.filter("id = 'p4'"), "id")["status"] == "error"


def test_every_configured_normalisation_changes_the_table_and_unknown_ones_are_refused(spark):
    from helixmill.bundle import OmicsTables
    from helixmill.config import ALLOWED

    omic = spark.createDataFrame([("a", 1.0, 40.0), ("b", 3.0, 20.0), ("c", 8.0, None), ("d", 2.0, 31.0)], "k string, g double, h double")
    clinical = omic.select("k", (F.col("g") * 2).alias("age"))
    plain = {r["k"]: (r["g"], r["h"]) for r in pipeline.preprocess(omic, "k").collect()}
    for method in sorted(ALLOWED["preprocessing.normalization.method"]):
        out = pipeline.run_checked(omic, clinical, "k", normalisation=method)
        assert out["status"] == "success" and {r["k"]: (r["g"], r["h"]) for r in out["data"].collect()} != plain, method
    assert pipeline.run_checked(omic, clinical, "k", normalisation="nonsense")["status"] == "error"
    with pytest.raises(PreprocessingError):
        normalize.normalize_wide(omic, "k", "nonsense")
    bundle = OmicsTables({"rna": omic, "lab": clinical}, "k")
    assert bundle.scale("robust", {"lab": "odd"}).problems.keys() == {"lab"}
    fitted = bundle.fit("minmax", {"lab": "median_centering"})
    assert sorted(r["g"] for r in fitted.transform(bundle).tables["rna"].collect()) == [0.0, pytest.approx(1 / 7), pytest.approx(2 / 7), 1.0]
    later = OmicsTables({"rna": omic.limit(0), "other": omic}, "k")
    assert fitted.transform(later).tables["other"].filter("g = 8").count() == 1


def test_the_configuration_reaches_the_pipeline(spark, tmp_path):
    from helixmill import cli

    rows = [(f"p{i:02d}", float(i), float(i % 5), None if i % 3 else 1.0) for i in range(30)] + [("p99", 9e6, 1.0, 1.0)]
    spark.createDataFrame(rows, "patient_id string, g double, h double, sparse double").coalesce(1).write.option("header", True).csv(str(tmp_path / "omic"))
    spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "patient_id string, grp int").coalesce(1).write.option("header", True).csv(str(tmp_path / "clinical"))
    (tmp_path / "c.yaml").write_text("preprocessing: {imputation: {method: median, threshold_missing: 0.5}, normalization: {method: minmax}, outliers: {method: zscore}}\nexport: {format: ml, target: grp, test_size: 0.3}\n")
    assert cli.main(["--omic", str(tmp_path / "omic"), "--clinical", str(tmp_path / "clinical"), "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.yaml")]) == 0
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert set(out.columns) == {"patient_id", "g", "h", "grp", "split"} and out.count() == 30 and out.filter("patient_id = 'p99'").count() == 0
    assert out.agg(F.max("g")).first()[0] == 1.0 and 4 <= out.filter("split = 'test'").count() <= 14
    forest = pipeline.outlying(spark.createDataFrame(rows, "patient_id string, g double, h double, sparse double").drop("sparse"), "patient_id", "isolation_forest", 0.05)
    assert "p99" in {r["patient_id"] for r in forest.collect()}


def test_components_of_a_long_chain(spark):
    from helixmill.operators import fuzzy

    n = 300
    chain = spark.createDataFrame([(f"x{i:04d}", f"x{i + 1:04d}") for i in range(n)] + [("y1", "y2"), ("y2", "y1"), ("z", "z")], "a string, b string")
    got = {r["node"]: r["component"] for r in fuzzy.components(chain).collect()}
    assert got == {f"x{i:04d}": "x0000" for i in range(n + 1)} | {"y1": "y1", "y2": "y1"}


def test_entity_attributes_of_any_length(spark):
    from helixmill.sources import readers

    lines = spark.createDataFrame([("d", 0, "^SAMPLE = s1"), ("d", 1, "!note = " + "x" * 1_200_000)], "document string, line_no int, value string")
    assert len(readers.parse_entities(lines).first()["values"][0]) == 1_200_000


def test_correlations_against_numpy_in_one_and_in_many_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 7)) + 1000
    x[:, 3] = x[:, 2] * 2 + rng.normal(size=40) * 0.01
    x[:, 5] = 3.3
    gone = rng.random(x.shape) < 0.2
    rows = [(i, f"f{j}", None if gone[i, j] else float(x[i, j])) for i in range(40) for j in range(7)]
    df = spark.createDataFrame(rows, "sample int, feature string, value double")
    for block in (500, 3):
        got = {(r["feature_a"], r["feature_b"]): r for r in quality.correlations(df, block=block).collect()}
        assert len(got) == 21
        for (a, b), r in got.items():
            i, j = int(a[1]), int(b[1])
            both = ~gone[:, i] & ~gone[:, j]
            assert r["n"] == both.sum()
            if 5 in (i, j):
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert quality.correlations(df.limit(0)).count() == 0


def test_principal_components_of_more_features_than_samples(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 30)) * rng.uniform(0.5, 3, 30)
    df = spark.createDataFrame([(f"s{i:02d}", f"f{j:02d}", float(x[i, j])) for i in range(12) for j in range(30)], "sample string, feature string, value double")
    scores, loadings, ratios = reduce.pca_long(df, 3)
    wide = matrix.to_wide(df, "sample", "feature", "value", [f"f{j:02d}" for j in range(30)])
    other = reduce.pca(wide, "sample", [f"f{j:02d}" for j in range(30)], 3, scale=True)
    assert ratios == pytest.approx(other.ratios)
    mine, theirs = (sorted(tuple(r) for r in s.collect()) for s in (scores, other.scores))
    for a, b in zip(mine, theirs):
        assert a[0] == b[0] and [abs(v) for v in a[1:]] == pytest.approx([abs(v) for v in b[1:]], abs=1e-8)
    found = {r["feature"]: [r["PC1"], r["PC2"], r["PC3"]] for r in loadings.collect()}
    assert [abs(v) for v in found["f07"]] == pytest.approx(np.abs(other.loadings[7]).tolist(), abs=1e-8)


@pytest.mark.parametrize("tolerance", [0.6, 0.8, 0.9])
def test_short_strings_meet_whoever_is_similar(spark, tolerance):
    import random
    from difflib import SequenceMatcher

    from helixmill.operators import fuzzy

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab1P0|") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {f"P{i:03d}" for i in range(30)} | {"", "x"})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", tolerance).collect()}
    assert got == {(x, y) for x in words for y in words if x and y and SequenceMatcher(None, x, y).ratio() >= tolerance}


def test_a_long_entity_file_is_read_in_splits(spark, tmp_path):
    from helixmill.sources import readers

    body = ["!Series_title = t", "^DATABASE = Geo"]
    for i in range(300):
        body += [f"^SAMPLE = s{i}", f"!title = sample {i}", "!characteristics_ch1 = age: 1", "!characteristics_ch1 = sex: F", "# a note", "ID\tVALUE", f"p1\t{i}.5", ""]
    (tmp_path / "a.soft").write_text("\r\n".join(body))
    (tmp_path / "b.soft").write_text("^SAMPLE = other\n!title = x\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (kept, "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.read_entities(spark, str(tmp_path / "*.soft")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        got = {(r["entity_type"], r["entity_id"], r["key"]): r["values"] for r in rows}
        assert len(rows) == len(got) == 1 + 300 * 3 + 1
        assert got[None, None, "Series_title"] == ["t"] and got["SAMPLE", "other", "title"] == ["x"]
        for i in (0, 57, 299):
            assert got["SAMPLE", f"s{i}", None] == ["ID\tVALUE", f"p1\t{i}.5"] and got["SAMPLE", f"s{i}", "characteristics_ch1"] == ["age: 1", "sex: F"] and got["SAMPLE", f"s{i}", "title"] == [f"sample {i}"]
