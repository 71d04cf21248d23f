import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import fill

SCHEMA = "row_id long, patient string, site string, load_id int, age double, stage string, n long, s double"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1, 1.0) for i, r in enumerate(rows)], SCHEMA)


def fill_age(df, **options):
    return fill.fill_number(df, "age", fill.usable_number(F.col("age"), 0.0, 120.0, low_open=True), ["site", "load_id"], "patient", low=0.5, high=120.0, **options)


@pytest.mark.parametrize(
    ("text", "stage"),
    [("III", "III"), ("Stage ii", "II"), ("stade IV", "IV"), ("3", "III"), ("ⅲ", "III"), ("iiia", "III"), ("St. 2", "II"), ("pstage one", "I"), ("AJCC Stage IVB", "IV"), ("n/a", None), ("?", None), ("", None), (" ", None), (None, None), ("TBD", None), ("inconnu", None), ("5", None)],
)
def test_stage_of(spark, text, stage):
    df = spark.createDataFrame([(text,)], "t string").select(fill.stage_of(F.col("t")).alias("x"))
    assert df.first()["x"] == stage


def test_gaps_are_marked_and_filled_and_rows_stay(spark):
    rows = [("p1", "a", 1, 60.0, "II"), ("p-1", "a", 1, None, "x"), ("p2", "b", 2, float("nan"), None), ("p3", "b", 2, 0.0, "III"), ("p4", "b", 1, 150.0, "III"), (None, None, None, -9.0, "III"), ("p5", "a", 2, 40.0, "stage 3")]
    df = frame(spark, rows)
    out = {r["row_id"]: r for r in fill_age(df).collect()}
    assert len(out) == len(rows) and {i for i, r in out.items() if r["age_filled"]} == {1, 2, 3, 4, 5}
    assert all(0 < r["age"] <= 120 for r in out.values()) and out[0]["age"] == 60.0 and set(out[0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], "age_filled"}
    staged = {r["row_id"]: r for r in fill.fill_category(df, "stage", fill.stage_of(F.col("stage")), fill.STAGES, ["site"], "patient").collect()}
    assert {i for i, r in staged.items() if r["stage_filled"]} == {1, 2} and staged[1]["stage"] == "II" and all(r["stage"] in fill.STAGES for r in staged.values())


def test_nothing_to_fill_from(spark):
    df = frame(spark, [("p", "a", 1, None, None), ("q", None, 2, None, "?")])
    assert [(r["age"], r["age_filled"]) for r in fill_age(df).collect()] == [(None, True)] * 2
    out = fill.fill_category(df, "stage", fill.stage_of(F.col("stage")), fill.STAGES, ["site"], "patient").collect()
    assert [(r["stage"], r["stage_filled"]) for r in out] == [(None, True)] * 2
    assert fill_age(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """Masked cells are predicted better by groups and subjects than by the general mean or mode."""
    rng = random.Random(3)
    site = {s: rng.gauss(0, 8) for s in "abcdef"}
    rows, truth = [], {}
    for p in range(400):
        s, own, st = rng.choice("abcdef"), rng.gauss(0, 5), rng.choice(["I", "II", "III", "IV"])
        for v in range(3):
            age, stage = 55 + site[s] + own + rng.gauss(0, 2), st if rng.random() < 0.9 else "I"
            if rng.random() < 0.15:
                truth[len(rows)] = (age, stage)
                age, stage = None, None
            rows.append((f"p{p}", s, v, age, stage))
    df = frame(spark, rows)
    got = {r["row_id"]: r["age"] for r in fill_age(df).filter("age_filled").collect()}
    known = [r[3] for r in rows if r[3] is not None]
    mean = sum(known) / len(known)
    error = sum((got[i] - a) ** 2 for i, (a, _) in truth.items()) ** 0.5
    naive = sum((mean - a) ** 2 for a, _ in truth.values()) ** 0.5
    assert error < 0.5 * naive
    stages = {r["row_id"]: r["stage"] for r in fill.fill_category(df, "stage", fill.stage_of(F.col("stage")), fill.STAGES, ["site", "load_id"], "patient").filter("stage_filled").collect()}
    assert sum(stages[i] == s for i, (_, s) in truth.items()) > 0.6 * len(truth)


def test_fits_on_the_cluster_and_in_one_process_agree(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        s, load = rng.choice(["a", "b", "c", None]), rng.randint(1, 3)
        stage = rng.choices(["I", "II", "III", "IV"], [1, 2, 3 if s == "a" else 1, load])[0]
        rows.append((f"p{i // 2}", s, load, 50.0 + 5 * load + (10 if s == "a" else 0) + rng.gauss(0, 2) if i % 6 else None, stage if i % 7 else None))
    df = frame(spark, rows)
    ages = [{r["row_id"]: r["age"] for r in fill_age(df, most_cells=m).collect()} for m in (0, 10_000)]
    assert ages[0] == {i: pytest.approx(a, abs=1e-9) for i, a in ages[1].items()}
    stages = [{r["row_id"]: (r["stage"], r["stage_share"]) for r in fill.fill_category(df, "stage", fill.stage_of(F.col("stage")), fill.STAGES, ["site", "load_id"], "patient", numbers=["age"], most_cells=m).collect()} for m in (0, 10_000)]
    assert {i: s for i, (s, _) in stages[0].items()} == {i: s for i, (s, _) in stages[1].items()}
    assert [p for _, (_, p) in sorted(stages[0].items())] == pytest.approx([p for _, (_, p) in sorted(stages[1].items())], abs=1e-9)


def test_the_model_of_classes_is_a_ridge_logit_fit(spark):
    """After many sweeps the gradient of the penalised likelihood is zero for every level."""
    import numpy as np

    cells = [("a", "x", 8, 1, 3), ("a", "y", 2, 2, 2), ("b", "x", 1, 9, 4), ("b", None, 0, 3, 1), ("c", "y", 5, 5, 0)]
    df = spark.createDataFrame(cells, "_f0 string, _f1 string, c0 long, c1 long, c2 long")
    start = np.log(np.array([16, 20, 10]) / 46)
    u = [{r["_level"]: np.array(r["_u"]) for r in e.collect()} for e in fill._class_effects(df, ["_f0", "_f1"], 3, start, 60, 100).values()]
    for f in (0, 1):
        for level, effect in u[f].items():
            g = -fill.RIDGE * effect
            for row in cells:
                if row[f] == level:
                    eta = start + u[0].get(row[0], 0) + u[1].get(row[1], 0)
                    p = np.exp(eta) / np.exp(eta).sum()
                    g = g + np.array(row[2:]) - sum(row[2:]) * p
            assert np.abs(g).max() < 1e-6


@pytest.mark.parametrize("text", ["", "--", "ND", "n/a", "0000", "xxx", "Unknown", None, " "])
def test_stand_ins_are_no_subject(spark, text):
    df = spark.createDataFrame([(text,), ("TCGA-8E-h2k9",)], "p string").select(fill.subject_key("p").alias("k")).collect()
    assert [r["k"] for r in df] == [None, "TCGA8EH2K9"]


def test_stand_ins_share_no_effect(spark):
    rows = [("ND", "a", 1, 90.0, "IV")] * 8 + [(f"p{i}", "a", 1, 50.0, "I") for i in range(40)] + [("ND", "a", 1, None, None), ("TCGA", "a", 1, None, None)]
    df = frame(spark, rows)
    out = {r["row_id"]: r["age"] for r in fill_age(df).collect()}
    assert out[48] == pytest.approx(out[49]) and out[48] < 60
