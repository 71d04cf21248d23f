from datetime import datetime as dt

from helixmill.operators.orphans import Reference, orphan_report, orphan_rows

D = [dt(2024, m, 1) for m in range(1, 13)]
CHILD = "row_id long, ref string, loaded_at timestamp_ntz, parent string, key string, salt int"
PARENT = "id string, loaded_at timestamp_ntz, retracted_at timestamp_ntz, key string"


def reference(spark, child, parent):
    c = spark.createDataFrame([(i, r, t, "x", "y", 1) for i, (r, t) in enumerate(child)], CHILD)
    p = spark.createDataFrame([(*x, "z") for x in parent], PARENT)
    return Reference("t", c, "ref", p, "id")


def orphans(spark, child, parent):
    return {r["row_id"] for r in orphan_rows([reference(spark, child, parent)]).collect()}


def test_spelling_absence_and_placeholders(spark):
    child = [("ab-1", D[5]), (" AB 1\t", D[5]), ("Ab–1", D[5]), ("ab-2", D[5]), ("n/a", D[5]), ("?", D[5]), (None, D[5]), ("  ", D[5]), (" ", D[5])]
    assert orphans(spark, child, [("AB-1", D[0], None)]) == {3, 4, 5}


def test_time_of_arrival_and_withdrawal(spark):
    parent = [("a", D[2], None), ("b", D[0], D[4]), ("c", D[0], D[1]), ("c", D[3], None)]
    child = [("a", D[1]), ("a", D[2]), ("b", D[3]), ("b", D[4]), ("b", D[5]), ("c", D[0]), ("c", D[2]), ("c", D[3])]
    assert orphans(spark, child, parent) == {0, 3, 4, 6}


def test_null_times_and_empty_parents(spark):
    assert orphans(spark, [("a", None), ("a", D[1])], [("a", D[0], None)]) == {0}
    assert orphans(spark, [("a", D[1])], [("a", None, None)]) == {0}
    assert orphans(spark, [("a", D[1]), (None, D[1])], []) == {0}
    assert orphans(spark, [], [("a", D[0], None)]) == set()


def test_repeated_rows_stay_and_are_counted(spark):
    child = [("gone", D[0])] * 50 + [("here", D[1])] * 3
    ref = reference(spark, child, [("here", D[0], None), ("here", D[0], None)])
    assert orphan_rows([ref]).count() == 50
    got = {(r["month"], r["n_references"], r["n_orphans"]) for r in orphan_report([ref]).collect()}
    assert got == {("2024-01", 50, 50), ("2024-02", 3, 0)}
