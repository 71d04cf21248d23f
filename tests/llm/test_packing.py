import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm.packing import best_two_fit, pack, summary


@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
@settings(max_examples=150, deadline=None)
def test_every_item_once_and_no_container_too_full(sizes, capacity):
    bins = best_two_fit(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert all(0 < x <= capacity for x in loads)
    # no two containers could be one, but for the last
    assert sum(2 * x <= capacity for x in loads) <= 1


def test_two_items_fill_better_than_one():
    """10: greedy takes 6 and 3; in place of 3, the gap of 4 takes 2 and 2."""
    bins = best_two_fit([6, 3, 2, 2], 10)
    assert [sorted([6, 3, 2, 2][i] for i in b) for b in bins][0] == [2, 2, 6]


def packed(spark, sizes, capacity, **options):
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens int, plan_id string")
    plans = spark.createDataFrame([("p", capacity), ("none", None), ("zero", 0)], "plan_id string, capacity_tokens int")
    return pack(df, plans, **options)


@pytest.mark.parametrize("shard_items", [20_000, 50])
def test_whole_items_and_splits(spark, shard_items):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 5, 100, 101, 250, 300, rng.randint(1, 99)])) for i in range(300)]
    rows = packed(spark, sizes, 100, shard_items=shard_items).collect()
    loads, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r["container_id"]] += r["n_tokens"]
        pieces[r["doc_id"]].append((r["token_start"], r["token_end"]))
        assert r["token_end"] - r["token_start"] == r["n_tokens"]
    assert all(100 - loads[r["container_id"]] == r["unused_tokens"] >= 0 for r in rows)
    for i, n in sizes:
        spans = sorted(pieces[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-n // 100))
    positions = defaultdict(list)
    for r in rows:
        positions[r["container_id"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())


def test_empty_texts_and_tables(spark):
    rows = packed(spark, [(1, 0), (2, 0)], 10).collect()
    assert [(r["n_tokens"], r["unused_tokens"]) for r in rows] == [(0, 10)] * 2
    assert packed(spark, [], 10).count() == 0
    assert summary(packed(spark, [(1, 10), (2, 4), (3, 6), (4, 25)], 10)).first().asDict() == {"plan_id": "p", "containers": 5, "items": 6, "tokens": 45, "unused_tokens": 5, "used_share": 0.9}


def test_repeated_ids_are_separate(spark):
    rows = packed(spark, [(1, 7), (1, 7), (1, 10), (1, 10)], 10).collect()
    assert len({r["container_id"] for r in rows}) == 4


def test_too_many_plans_are_refused_and_none_is_dropped(spark, monkeypatch):
    from helixmill.llm import packing

    sizes = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens int")
    plans = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "plan_id string, capacity_tokens int")
    assert pack(sizes, plans).select("plan_id").distinct().count() == 3
    monkeypatch.setattr(packing, "MOST_PLANS", 2)
    with pytest.raises(ValueError):
        pack(sizes, plans)


def test_the_audit_sees_what_is_wrong(spark):
    from pyspark.sql import functions as F

    from helixmill.llm.packing import audit

    sizes = spark.createDataFrame([(1, 7), (2, 3), (3, 25), (4, 0), (5, None)], "doc_id long, n_tokens int")
    plans = spark.createDataFrame([("p", 10)], "plan_id string, capacity_tokens int")
    good = pack(sizes, plans)
    assert audit(good, sizes, plans).first().asDict() == {"plan_id": "p", "n_docs": 5, "n_missing": 0, "n_wrong_tokens": 0, "n_split_in_vain": 0, "n_wrong_containers": 0}
    assert audit(good, sizes, plans.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, 12), (None, 3), (1, 4)], "doc_id long, n_tokens int")
    told = audit(pack(nameless, plans), nameless, plans).first()
    assert told["n_docs"] == 3 and told["n_missing"] == 0 and told["n_wrong_tokens"] == 0 and told["n_wrong_containers"] == 0
    bad = audit(good.filter("doc_id <> 1").withColumn("n_tokens", F.when(F.col("doc_id") == 2, 99).otherwise(F.col("n_tokens"))), sizes, plans).first()
    assert bad["n_missing"] == 1 and bad["n_wrong_tokens"] == 1 and bad["n_wrong_containers"] >= 1


def test_pieces_are_encoded_as_the_whole_is(monkeypatch):
    from helixmill.llm import tokens

    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "Zü", " ", "  ", "\n", ".", "12", "_", "'s", "é", "漢字"]) for _ in range(3000)) for _ in range(5)] + ["x" * 90_000, "word " * 20_000]
    whole = [tokens._counter(tokens.TOKENIZER)(t) for t in texts if len(t) < tokens.PIECE]
    monkeypatch.setattr(tokens, "PIECE", 50)
    assert all("".join(tokens._parts(t)) == t for t in texts) and len(list(tokens._parts(texts[0]))) > 10 and len(list(tokens._parts("x" * 90_000))) == 1
    assert [tokens._counter(tokens.TOKENIZER)(t) for t in texts if len(t) < 20_000] == whole
