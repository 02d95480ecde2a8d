import random

import pytest

from graphloom.llm.packing import pack, pack_documents

SIZES = [("short", 16), ("page", 64), ("long", 256)]


@pytest.mark.parametrize("seed", range(6))
def test_pack_uses_every_item_once_and_little_room(seed):
    rng = random.Random(seed)
    items = [min(256, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(3000)]
    bins = pack(items, [16, 64, 256])
    used = []
    for capacity, plan in bins:
        full = sum(s * n for s, n in plan)
        assert 0 < full <= capacity and not any(full <= c < capacity for c in (16, 64))
        used += [s for s, n in plan for _ in range(n)]
    assert sorted(used) == sorted(items)
    assert sum(items) / sum(c for c, _ in bins) > 0.995


def test_pack_small_cases():
    assert pack([], [8]) == [] and pack([0], [8]) == []
    assert pack([8], [8, 16]) == [(8, [(8, 1)])]
    assert sum(c for c, _ in pack([5, 5, 5], [8])) == 24
    assert [c for c, _ in pack([6, 5, 5], [16])] == [16]


def check(rows, sizes, capacities):
    by_bin, by_doc = {}, {}
    most = max(c for _, c in capacities)
    names = {c: n for n, c in capacities}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for rs in by_bin.values():
        (capacity,), (used,) = {r.capacity for r in rs}, {r.used for r in rs}
        assert sum(r.tokens for r in rs) == used <= capacity and {r.container for r in rs} == {names[capacity]}
        at = 0
        for r in sorted((r for r in rs if r.tokens), key=lambda r: r.offset):
            assert r.offset == at
            at += r.tokens
    assert {d: sum(r.tokens for r in rs) for d, rs in by_doc.items()} == sizes
    for d, rs in by_doc.items():
        assert len(rs) == max(1, -(-sizes[d] // most))
        assert sorted(r.start for r in rs) == [k * most for k in range(len(rs))]


@pytest.mark.parametrize("block", [40, 10_000])
def test_operator(spark, block):
    rng = random.Random(block)
    sizes = {d: rng.choice([0, 1, 16, 64, 256, 257, 1000, rng.randint(1, 300)]) for d in range(500)}
    rows = [(d, n if n or d % 2 else None) for d, n in sizes.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").selectExpr("*", "1 as bin", "2 as piece")
    check(pack_documents(df, SIZES, block).collect(), sizes, SIZES)


def test_empty_tables_and_bad_sizes(spark):
    df = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert pack_documents(df, SIZES).collect() == []
    nothing = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, tokens bigint")
    assert [(r.capacity, r.used, r.tokens) for r in pack_documents(nothing, SIZES).collect()] == [(16, 0, 0)] * 2
    with pytest.raises(ValueError):
        pack_documents(df, [])
