import random
from collections import defaultdict

import pytest

from graphloom.operators.heavy_keys import heavy_keys, per_key

AGGS = {"n": ("e", "count"), "low": ("e", "min"), "high": ("e", "max"), "total": ("v", "sum")}


def brute(rows):
    seen = {}
    for k, e, v in rows:
        seen.setdefault((k, e), v)
    by = defaultdict(list)
    for (k, e), v in seen.items():
        by[k].append((e, v))
    return {
        k: (
            len([e for e, _ in x if e is not None]),
            min((e for e, _ in x if e is not None), default=None),
            max((e for e, _ in x if e is not None), default=None),
            sum(v for _, v in x if v is not None) if any(v is not None for _, v in x) else None,
        )
        for k, x in by.items()
    }


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_matches_brute_force_with_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for e in range(3000):
        k = "hot" if e % 3 == 0 else rng.choice([None, "a", "b", *map(str, range(300))])
        v = (e * 7) % 11 if e % 10 else None  # the same for resent rows
        rows += [(k, e, v)] * rng.choice([1, 1, 1, 2, 3])
    df = spark.createDataFrame(rows, "k string, e bigint, v int")
    got = {r.k: (r.n, r.low, r.high, r.total) for r in per_key(df, ["k"], ["e"], AGGS, partitions).collect()}
    assert got == brute(rows)


def test_one_key_fills_all_partitions(spark):
    df = spark.createDataFrame([("x", e, 1) for e in range(1000)], "k string, e bigint, v int")
    r = per_key(df, ["k"], ["e"], AGGS, 8).collect()
    assert [(x.k, x.n, x.low, x.high, x.total) for x in r] == [("x", 1000, 0, 999, 1000)]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k string, e bigint, v int, n int, __edge int")
    assert per_key(df, ["k"], ["e"], AGGS).collect() == []


def test_null_order_counts_nothing(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", None, 1)], "k string, e bigint, v int")
    (r,) = per_key(df, ["k"], ["e"], AGGS).collect()
    assert (r.n, r.low, r.high) == (0, None, None)


def test_long_keys_and_unknown_aggregate(spark):
    df = spark.createDataFrame([("x" * 100_000, 1, 1)], "k string, e bigint, v int")
    assert per_key(df, ["k"], ["e"], AGGS).first().n == 1
    with pytest.raises(ValueError):
        per_key(df, ["k"], ["e"], {"n": ("e", "median")})


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("f", "a", 1), ("f", "b", 99), ("g", "c", 5)], "field string, k string, n bigint")
    assert sorted(r.k for r in heavy_keys(df, "field", "n", 100).collect()) == ["a", "b", "c"]
    assert sorted(r.k for r in heavy_keys(df, "field", "n", 99).collect()) == ["b", "c"]
