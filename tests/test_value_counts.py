import random
from statistics import median

import pytest

from helixmill.operators import value_counts as vc

SCHEMA = "load_id int, x double, extra string"


def counts(spark, rows, sign=1):
    return vc.delta(spark.createDataFrame([(a, b, "e") for a, b in rows], SCHEMA), "t", ["x"], sign=sign)


def profile(spark, rows, ranges=None):
    out = vc.profile(counts(spark, rows), ranges or {"x": (0.0, 100.0)}).collect()
    return {r["load_id"]: r for r in out}


def quantile(values, p):
    v, pos = sorted(values), p * (len(values) - 1)
    lo, hi = int(pos), -int(-pos // 1)
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


def test_profile_of_nulls_nans_and_repeats(spark):
    r = profile(spark, [(1, 1.0), (1, 1.0), (1, None), (1, float("nan")), (1, 500.0)])[1]
    assert (r["n_rows"], r["missing_share"], r["invalid_share"], r["n_distinct"], r["top_share"]) == (5, 0.4, 0.2, 2, 0.4)
    assert (r["median"], r["iqr"], r["min_value"], r["max_value"]) == (1.0, 0.0, 1.0, 500.0)
    assert r["entropy_bits"] == pytest.approx(0.9182958, abs=1e-6)


def test_only_missing_and_empty(spark):
    r = profile(spark, [(1, None), (1, None)])[1]
    assert r["missing_share"] == 1.0 and r["median"] is None and r["entropy_bits"] is None and r["top_share"] == 0
    assert profile(spark, []) == {}


def test_infinite_values_are_invalid(spark):
    r = profile(spark, [(1, float("inf")), (1, float("-inf")), (1, 2.0)])[1]
    assert r["invalid_share"] == pytest.approx(2 / 3) and r["median"] == 2.0


def test_quantiles_against_sorting(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, -1.5, rng.gauss(0, 1), rng.lognormvariate(3, 2), float(rng.randint(0, 9))])) for k in (1, 2, 3) for _ in range(rng.randint(1, 200))]
    got = {r["load_id"]: r for r in vc.quantiles(counts(spark, rows), vc.KEYS, {"a": 0.1, "b": 0.5, "c": 0.75}).collect()}
    for k in (1, 2, 3):
        mine = [x for i, x in rows if i == k]
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.75)):
            assert got[k][name] == pytest.approx(quantile(mine, p))


def test_ranks_against_sorting(spark):
    rows = [(1, x) for x in (3.0, 1.0, 3.0, -2.0, 0.0, 100.0)]
    got = {r["value"]: (r["before"], r["cnt"]) for r in vc.value_ranks(counts(spark, rows), vc.KEYS).collect()}
    assert got == {-2.0: (0, 1), 0.0: (1, 1), 1.0: (2, 1), 3.0: (3, 2), 100.0: (5, 1)}


def stored(df):
    return sorted((r["column_name"], str(r["load_id"]), str(r["value"]), str(r["text"]), r["cnt"]) for r in df.collect())


def test_deltas_add_and_take_away(spark):
    base = counts(spark, [(1, 1.0), (1, 2.0), (2, None)])
    after = vc.apply_deltas(base, [counts(spark, [(1, 2.0)], sign=-1), counts(spark, [(1, 1.0), (3, 9.0)])])
    assert stored(after) == stored(counts(spark, [(1, 1.0), (1, 1.0), (2, None), (3, 9.0)]))


def test_a_store_follows_its_tables(spark, tmp_path):
    """New, changed and withdrawn loads; what did not change is not counted again."""
    path = str(tmp_path / "store")
    states = [
        [(1, 1.0, "a"), (1, 2.0, None), (None, 7.0, "n")],
        [(1, 1.0, "a"), (1, 2.0, None), (None, 7.0, "n"), (2, float("nan"), "b"), (2, None, "b")],
        [(1, 1.0, "a"), (1, 3.0, "c"), (2, float("nan"), "b"), (2, None, "b")],
        [(1, 1.0, "a"), (1, 3.0, "c"), (2, float("nan"), "b"), (2, None, "b")],
        [],
        [(1, 1.0, "a")],
    ]
    versions = []
    for rows in states:
        df = spark.createDataFrame(rows, SCHEMA)
        kept = vc.maintain(spark, path, {"t": (df, ["x", "extra"])})
        assert stored(kept) == stored(vc.delta(df, "t", ["x", "extra"]))
        versions.append(spark.read.parquet(f"{path}/ledger").select("version").distinct().count())
    assert versions == [1, 2, 3, 3, 4, 5]
    assert spark.read.parquet(f"{path}/deltas").filter("cnt < 0").count() > 0


def test_an_update_that_was_broken_off_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, 1.0, "a")], SCHEMA)
    vc.maintain(spark, path, {"t": (df, ["x"])})
    spark.read.parquet(f"{path}/deltas").selectExpr("table_name", "column_name", "load_id", "value", "text", "cnt", "'unfinished' AS version").write.mode("append").parquet(f"{path}/deltas")
    assert stored(vc.maintain(spark, path, {"t": (df, ["x"])})) == stored(vc.delta(df, "t", ["x"]))


def test_text_columns_patterns_and_shifts(spark):
    rows = [(1, 0.0, "A1"), (1, 0.0, "b"), (1, 0.0, None), (2, 0.0, "A1"), (2, 0.0, "A1")]
    store = vc.delta(spark.createDataFrame(rows, SCHEMA), "t", ["extra"])
    got = {r["load_id"]: r for r in vc.profile(store, {}, {"extra": "^[A-Z][0-9]$"}).collect()}
    assert (got[1]["invalid_share"], got[1]["missing_share"], got[1]["n_distinct"], got[1]["min_text"], got[1]["max_text"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 2, "A1", "b")
    assert got[2]["invalid_share"] == 0 and got[2]["entropy_bits"] == 0 and got[2]["median"] is None
    # all loads: A1 3 of 4; load 1: 1 of 2; load 2: 2 of 2
    assert {r["load_id"]: r["shift"] for r in vc.shifts(store).collect()} == {1: pytest.approx(0.25), 2: pytest.approx(0.25)}


def test_a_load_that_differs(spark):
    rows = [(k, float(10 + i % 7)) for k in range(1, 6) for i in range(40)] + [(6, float(30 + i % 7)) for i in range(40)] + [(7, None if i % 2 else float(10 + i % 7)) for i in range(40)]
    out = vc.compare_loads(vc.profile(counts(spark, rows), {"x": (0.0, 100.0)})).filter("differs").collect()
    assert {r["load_id"] for r in out} == {6, 7}
    assert median([10 + i % 7 for i in range(40)]) == 13


def test_limits_are_not_cases(spark):
    """A share off by exactly 0.15 of the usual share is no case."""
    def load(k, missing):
        return [(k, None if i < missing else float(i)) for i in range(20)]

    out = vc.compare_loads(vc.profile(counts(spark, load(1, 2) + load(2, 2) + load(3, 2) + load(4, 6)), {"x": (0.0, 100.0)}))
    got = {r["load_id"]: r["differs"] for r in out.collect()}
    assert got[4] and not got[1]
