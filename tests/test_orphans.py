import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import orphans as op
from graphloom.operators.orphans import Children, Parents, orphan_references, orphan_report

T0 = datetime(2025, 1, 1, tzinfo=UTC)
CHILD, PARENT = "i bigint, k string, t timestamp", "k string, a timestamp, z timestamp"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def run(spark, children, parents):
    c = spark.createDataFrame([(i, k, at(t)) for i, k, t in children], CHILD)
    p = spark.createDataFrame([(k, at(a), at(z)) for k, a, z in parents], PARENT)
    return orphan_references([Children(c, "c", "i", "k", F.col("k"), "t")], [Parents(p, F.col("k"), "a", "z")])


def brute(children, parents):
    out = set()
    for i, k, t in children:
        if k is None:
            continue
        own = [(a, z) for q, a, z in parents if q == k]
        if t is None:
            ok = bool(own)
        else:
            ok = any(a is not None and a <= t and (z is None or t < z) for a, z in own)
        if not ok:
            out.add(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "HEAVY_ROWS", 50)
    monkeypatch.setattr(op, "HEAVY_SHARE", 0.1)
    rng = random.Random(seed)
    keys = ["hot", *map(str, range(20))]
    parents = []
    for k in keys:
        for _ in range(rng.randint(0, 3)):
            a = rng.choice([None, *range(10)])
            z = rng.choice([None, *range(12)])
            parents += [(k, a, z)] * rng.choice([1, 2])
    children = [(i, "hot" if i % 3 == 0 else rng.choice([None, *keys, "lost"]), rng.choice([None, *range(12)])) for i in range(400)]
    children += children[:40]
    got = [r.row_id for r in run(spark, children, parents).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(children, parents)


def test_ends_of_a_life(spark):
    parents = [("k", 1, 3), ("e", 5, 5), ("r", 6, 4)]
    children = [(1, "k", 0), (2, "k", 1), (3, "k", 2), (4, "k", 3), (5, "e", 5), (6, "e", None), (7, "r", 5), (8, "x", None)]
    assert {r.row_id for r in run(spark, children, parents).collect()} == {1, 4, 5, 7, 8}


def test_empty_tables_and_report(spark):
    assert run(spark, [], [("k", 1, None)]).collect() == []
    lost = run(spark, [(1, "k", 0), (2, "k", None), (3, "k", 24 * 40)], [])
    rows = {(r.month, r.orphans) for r in orphan_report(lost).collect()}
    assert rows == {("2025-01", 1), (None, 1), ("2025-02", 1)}
