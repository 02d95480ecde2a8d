import math
import random
from collections import defaultdict

import pytest

from graphloom.llm import topn
from graphloom.llm.topn import LoserTree, merge_top, top_n

SCHEMA = "g bigint, q string, s double"


def brute(rows, n):
    best = defaultdict(dict)
    for g, q, s in rows:
        if q is not None and s is not None and not math.isnan(s):
            best[g][q] = max(best[g].get(q, -math.inf), s + 0.0)
    return {g: [(q, s) for q, s in sorted(x.items(), key=lambda i: (-i[1], i[0]))[:n]] for g, x in best.items()}


def result(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.g is None, r.g or 0, r["rank"])):
        assert r["rank"] == len(out[r.g]) + 1
        out[r.g].append((r.q, r.s))
    return dict(out)


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(topn, "FAN_IN", 3)
    monkeypatch.setattr(topn, "RUN_ROWS", 100)
    monkeypatch.setattr(topn, "RECORD", 3 if seed % 2 else 4096)
    rows = []
    for _ in range(3000):
        g = 1 if rng.random() < 0.4 else rng.choice([None, *range(200)])
        q = rng.choice([None, "é", "z", "Z", "\U0001f600", "\uffee", *map(str, range(40))])
        s = rng.choice([None, math.nan, 0.0, -0.0, 1.0, -math.inf, math.inf, rng.randint(-3, 3) / 2])
        rows += [(g, q, s)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 as rank", "'x' as bucket", "2 as score")
    assert result(top_n(df, "g", "q", "s", 5)) == brute(rows, 5)


def test_empty_ties_and_one_group(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "q", "s", 5).collect() == []
    rows = [(1, f"q{k:04}", 1.0) for k in range(2000)]
    got = result(top_n(spark.createDataFrame(rows, SCHEMA).repartition(4), "g", "q", "s", 3))
    assert got == {1: [("q0000", 1.0), ("q0001", 1.0), ("q0002", 1.0)]}


def test_long_items(spark):
    rows = [(1, "x" * 200_000 + str(k), float(k)) for k in range(8)]
    assert [q[-1] for q, _ in result(top_n(spark.createDataFrame(rows, SCHEMA), "g", "q", "s", 2))[1]] == ["7", "6"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_sorts(n):
    rng = random.Random(n)
    runs = [sorted((0, rng.randint(0, 9), rng.random(), "") for _ in range(rng.randint(0, 20))) for _ in range(n)]
    tree, out = LoserTree(runs), []
    while tree.head is not LoserTree.END:
        out.append(tree.head)
        tree.advance()
    assert out == sorted(x for r in runs for x in r)


def test_seek_leaves_a_group_behind():
    runs = [[(0, 1, -k, str(k)) for k in range(1000, 0, -1)] + [(0, 2, -1.0, "b")] for _ in range(5)]
    assert [k[3] for k in merge_top(runs, 2)] == ["1000", "999", "b"]


@pytest.mark.parametrize("seed", range(5))
def test_records_are_merged_as_they_come(seed):
    rng = random.Random(seed)
    runs = [sorted((0, rng.randint(0, 6), -float(rng.randint(0, 9)), str(rng.randint(0, 30))) for _ in range(rng.randint(1, 60))) for _ in range(9)]
    records = sorted((r[i : i + 4] for r in runs for i in range(0, len(r), 4)), key=lambda x: x[0])
    merger, out, most = topn.Merger(3), [], 0
    for r in records:
        out += merger.add(r)
        most = max(most, len(merger.tree.sources))
    out += merger.drain()
    assert [k[:4] for k in out] == merge_top(runs, 3) and most <= 2 * len(runs)
