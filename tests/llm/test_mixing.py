import random
from collections import Counter

from pyspark.sql import functions as F

from helixmill.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame([(i, s, n, "x") for i, s, n in rows], "doc_id long, source string, n_tokens int, repeats string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def mixed(spark, rows, wanted, total=None):
    docs = mixing.hashed(frame(spark, rows))
    plan = mixing.plan(docs, mixing.read_targets(targets(spark, wanted)), total)
    return mixing.choose(docs, plan).collect(), {r["source"]: r for r in mixing.report(docs, plan).collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["big_one", "Big One", "BIG-ONE", "small", "mid", None, "stranger"]), rng.randint(0, 400)) for i in range(3000)]


def test_shares_repeats_and_names(spark):
    chosen, report = mixed(spark, corpus(), [("big_one", 0.3, 1), ("small", 0.4, 3), ("mid", 0.2, 2), ("absent", 0.1, 2)])
    assert {s: r["status"] for s, r in report.items()} == {"big_one": "met", "small": "met", "mid": "met", "absent": "no documents", "(untargeted)": "untargeted"}
    for s, w in (("big_one", 0.3), ("small", 0.4), ("mid", 0.2)):
        assert abs(report[s]["actual_share"] - w / 0.9) < 0.005
    assert all(1 <= r["repeats"] <= {"big_one": 1, "small": 3, "mid": 2}[r["source"]] for r in chosen)
    assert max(Counter(r["doc_id"] for r in chosen).values()) == 1
    assert sum(r["tokens"] for r in report.values()) == sum(r["n_tokens"] * r["repeats"] for r in chosen)


def test_a_larger_total_keeps_what_was_chosen_and_names_the_short(spark):
    rows = corpus(2)
    wanted = [("big_one", 0.5, 2), ("small", 0.5, 1)]
    small, _ = mixed(spark, rows, wanted, total=30_000)
    large, _ = mixed(spark, rows, wanted, total=60_000)
    more = {r["doc_id"]: r["repeats"] for r in large}
    assert all(more.get(r["doc_id"], 0) >= r["repeats"] for r in small) and len(large) > len(small)
    _, report = mixed(spark, rows, wanted, total=1e7)
    assert report["small"]["status"] == "too few tokens" and report["small"]["tokens"] == report["small"]["available_tokens"]


def test_threshold_is_as_near_as_one_document(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(10_000 + i, "b", 10) for i in range(1000)]
    for total in (100, 1234, 7777, 15_000):
        chosen, _ = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)], total=total)
        sums = Counter()
        for r in chosen:
            sums[r["source"]] += r["n_tokens"]
        assert all(abs(sums[s] - total / 2) <= 10 for s in "ab"), (total, sums)


def test_equal_hashes_zero_sizes_and_empty_tables(spark):
    chosen, _ = mixed(spark, [(1, "a", 100)] * 4 + [(2, "a", 0), (3, "b", None)], [("a", 1.0, 2), ("b", None, None)])
    assert {r["repeats"] for r in chosen if r["doc_id"] == 1} == {2}
    chosen, report = mixed(spark, [], [("a", 0.7, 1), ("b", 0.3, 1)])
    assert chosen == [] and {r["status"] for r in report.values()} == {"no documents", "untargeted"}
    chosen, report = mixed(spark, [(1, "a", 5)], [])
    assert chosen == [] and report["(untargeted)"]["available_tokens"] == 5


def test_token_counts_of_long_and_odd_texts(spark):
    from helixmill.llm import tokens

    texts = [None, "", "one two", "word " * 30_000, "x" * 30_000, "é\u0000 \U0001f600"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["n"] for r in df.select("i", tokens.n_tokens(F.col("text")).alias("n")).orderBy("i").collect()]
    assert got[:3] == [0, 0, 2] and 29_990 <= got[3] <= 60_001 and got[4] > 0 and got[5] > 0


def test_one_source_in_two_spellings_is_one_target(spark):
    rows = [(i, "a b" if i % 2 else "c", 10) for i in range(400)]
    chosen, report = mixed(spark, rows, [("A_B", 0.3, 1), ("a-b", 0.3, 2), ("c", 0.4, 1)])
    assert set(report) == {"A_B", "c", "(untargeted)"} and report["A_B"]["target_share"] == 0.6 and report["A_B"]["max_repeats"] == 1
    assert abs(report["A_B"]["actual_share"] - 0.6) < 0.01
