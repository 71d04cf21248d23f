import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.llm import content, passages
from helixmill.llm.neighbours import BlockMaxIndex, weigh

rows_of_features = st.lists(st.lists(st.integers(0, 63), max_size=12), min_size=1, max_size=150)


@given(rows_of_features, st.lists(st.integers(0, 63), max_size=12), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_index_equals_brute_force(rows, query, k):
    idf = (1 + np.arange(64) % 7).astype(np.float32)
    ids, sims = BlockMaxIndex(rows, idf).nearest(query, k)

    def dense(row):
        v = np.zeros(64, dtype=np.float64)
        c, w = weigh(row, idf)
        v[c] = w
        return v

    truth = np.sort([float(dense(r) @ dense(query)) for r in rows])[::-1]
    truth = truth[truth > 1e-6][:k]
    assert len(ids) == len(truth) == len(set(ids.tolist())) and np.allclose(sims, truth, atol=1e-5)


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("IDIOT", "idiot"), ("idiooooot", "idiot"), ("ídiôt", "idiot"), ("id-iot", "idiot"), ("іdіоt", "idiot"), ("prÃ©fÃ¨re", "prefere")],
)
def test_disguises(disguised, plain):
    assert passages.plain(disguised) == plain


def test_passages_cover_the_whole_text(spark):
    long = "".join(f"w{chr(97 + i % 26)}x " for i in range(15_000))
    df = spark.createDataFrame([(1, "One. Two!\nThree 12.5 mm S123-A.  Four: five"), (2, None), (3, ""), (4, "123 ..."), (5, long)], "i int, text string")
    got = {r["i"]: r["p"] for r in df.select("i", passages.passages(F.col("text")).alias("p")).collect()}
    assert got[1] == ["One.", "Two!", "Three 0 mm 0.", "Four: five", "five"] and got[2] == got[3] == got[4] == []
    assert all(len(p) <= passages.WINDOW for p in got[5]) and len(got[5]) >= len(set(long[i : i + passages.WINDOW] for i in range(0, 80 * passages.STEP, passages.STEP))) // 8


INSULTS = ["You are a complete {} and everybody knows it.", "Only a lazy {} would write that.", "Shut up you {}, go away."]
NAMES = ["idiot", "moron", "clown", "loser", "fool", "pig"]
HARMLESS = ["The sample was stored at four degrees.", "Please send the results by letter.", "The meeting was moved to Monday.", "Memory grows with every further table.", "The idiot-proof label works well."]


def corpus(spark):
    docs, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        body = [HARMLESS[(i + k) % len(HARMLESS)] for k in range(4)]
        if bad:
            body.insert(i % 4, INSULTS[i % 3].format(NAMES[(i // 6) % 6]))
        docs.append((i, " ".join(body), "s" if i % 2 else None, "x"))
        if i % 4 != 3:
            labels.append((i, "r", "abusive" if bad else "none"))
    docs += [(1000, None, "s", "x"), (1001, "", "s", "x"), (1002, "...", "s", "x"), (1003, "You are a c0mplete 1d10t and everybody knows it. " + "Memory grows with every further table. " * 1500, "s", "x"), (1003, "You are a complete idiot and everybody knows it.", "s", "x")]
    labels += [(5, "q", "abusive"), (99_999, "r", "sexual"), (7, "r", "odd"), (None, "r", "none")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score string").select("doc_id", "text", "source"), spark.createDataFrame(labels, "doc_id long, annotator string, category string")


def test_scores_find_the_insulting_documents(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in content.all_scores(docs, labels).collect()}
    assert set(got) == set(range(240)) | {1000, 1001, 1002, 1003}
    bad = {i for i, r in got.items() if r["score"] >= content.THRESHOLD}
    truth = {i for i in range(0, 240, 6)} | {1003}
    assert bad == truth
    assert all(got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[6]["category"] == "abusive" and got[6]["passage"]
    rates = {r["source"]: r["n_flagged"] for r in content.rates(content.all_scores(docs, labels)).collect()}
    assert rates["(none)"] == 40


def test_without_labels_and_without_documents(spark):
    docs, labels = corpus(spark)
    few = docs.filter("doc_id in (0, 1, 1000)")
    got = {r["doc_id"]: r["score"] for r in content.all_scores(few, labels.limit(0)).collect()}
    assert set(got) == {0, 1, 1000} and got[1] < content.THRESHOLD and got[1000] == 0
    assert content.all_scores(docs.limit(0), labels).count() == 0


SECRET = "Nobody could ever want such a rotten turnip as our dear colleague."


@pytest.mark.parametrize("n", [1, 6, 60])
def test_a_copy_of_a_labelled_passage_is_found_with_any_number_of_labels(spark, n):
    docs = [(i, " ".join(HARMLESS[(i + k) % len(HARMLESS)] for k in range(3)), "s") for i in range(200)]
    docs += [(1000 + i, f"{HARMLESS[i % 5]} {SECRET}", "s") for i in range(n)] + [(5000, SECRET, "s"), (5001, f"{HARMLESS[0]} {SECRET.upper()}", "s")]
    labels = [(i, "r", "none") for i in range(100)] + [(1000 + i, "r", "abusive") for i in range(n)]
    got = content.score_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, annotator string, category string"))
    found = {r["doc_id"]: r for r in got.filter(F.col("score") >= content.THRESHOLD).collect()}
    assert set(found) == {1000 + i for i in range(n)} | {5000, 5001}
    assert found[5000]["like_passage"] == SECRET and found[5000]["like_doc_id"] == 1000


@given(st.lists(st.tuples(st.floats(0, 1), st.booleans()), max_size=30))
@settings(max_examples=100, deadline=None)
def test_the_curve_gives_a_full_vote_a_high_score(held):
    slope, offset = content.calibrate(np.array([v for v, _ in held]), np.array([float(y) for _, y in held]), np.ones(len(held)))
    model = content.Model(None, None, None, [], slope, offset)
    assert model.probability(1.0) >= 0.9 and model.probability(0.25) < content.THRESHOLD


def test_readers_who_disagree_make_single_labels_worth_less():
    import pandas as pd

    positive = pd.DataFrame({"n_positive": [1, 2, 1], "n_none": [0, 0, 1]})
    assert content.label_worth(positive, 100, 0, 0).tolist() == [1.0, 1.0, 0.5]
    worth = content.label_worth(positive, 100, 50, 2)
    assert worth[1] > 0.9 > worth[0] > worth[2]


def test_workers_need_not_have_the_package(tmp_path):
    """Scoring from another folder, with the package known to the driver alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    (tmp_path / "job.py").write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from helixmill.session import local_session\nfrom helixmill.llm import content\nfrom helixmill.operators import impute\n"
        "spark = local_session('2', 2)\n"
        "docs = spark.createDataFrame([(1, 'You are a stupid idiot.'), (2, 'The tube is full.')], 'doc_id long, text string')\n"
        "labels = spark.createDataFrame([], 'doc_id long, annotator string, category string')\n"
        "print('FOUND', [r[0] for r in content.score_documents(docs, labels).filter('score >= 0.5').collect()])\n"
        "gaps = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.5, None), (3, 9.0, 8.0)], 'k long, a double, b double')\n"
        "print('FILLED', impute.impute_knn(gaps, 'k', ['a', 'b'], 1).filter('k = 2').first()['b'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [1]" in out.stdout and "FILLED 2.0" in out.stdout, out.stderr[-2000:]
