"""The N best items of every group by merging sorted runs.

Each task turns its rows into a sorted run, ordered by group, score and item, that keeps no more than N items of a group,
so a group of any size leaves a task as N rows. A run is cut into buckets by a hash of the group, and every bucket's part
into records of a bounded number of entries, which are stored in the shared folder. A bucket's records are then read in the
order of their first entries and merged with a loser tree; after N items of a group the merge seeks to the next group
everywhere. A record is read when the merge has come to its first entry, so a task holds no more than a record of each run,
however much there is in a bucket.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialise, ship

#: Rows of one run, entries of one stored record of it, and runs that ``merge_top`` merges at once.
RUN_ROWS, RECORD, FAN_IN = 1_000_000, 4096, 256


class LoserTree:
    """Merges sorted sequences: every inner node holds the loser of a match, so a new head plays log2(n) matches."""

    END = (2,)  # behind every key, whose first field is 0 or 1

    def __init__(self, sources: list[list[tuple]], at: list[int] | None = None) -> None:
        self.sources, self.n = sources, max(1, len(sources))
        self.at = at or [0] * len(sources)
        self.heads = [s[i] if i < len(s) else self.END for s, i in zip(sources, self.at, strict=True)] or [self.END]
        self.tree = [-1] * self.n
        self.winner = -1
        for i in range(self.n):
            self._enter(i)

    def _enter(self, i: int) -> None:
        """The first match of source ``i``: it waits in an empty node, or the loser of a match does."""
        node = (i + self.n) >> 1
        tree, heads = self.tree, self.heads
        while node > 0:
            other = tree[node]
            if other < 0:
                tree[node] = i
                return
            if heads[other] < heads[i]:
                tree[node], i = i, other
            node >>= 1
        self.winner = i

    def _replay(self, i: int) -> None:
        node = (i + self.n) >> 1
        tree, heads = self.tree, self.heads
        head = heads[i]
        while node > 0:
            other = tree[node]
            if heads[other] < head:
                tree[node], i = i, other
                head = heads[i]
            node >>= 1
        self.winner = i

    @property
    def head(self) -> tuple:
        return self.heads[self.winner]

    def advance(self, to: int | None = None) -> None:
        """The winner's source goes on by one, or to position ``to``."""
        w = self.winner
        at = self.at[w] = self.at[w] + 1 if to is None else to
        s = self.sources[w]
        self.heads[w] = s[at] if at < len(s) else self.END
        self._replay(w)

    def skip_group(self, group: tuple) -> None:
        """Seek to the first key behind ``group`` in every source."""
        size = len(group)
        while self.head[:size] == group:
            w = self.winner
            s = self.sources[w]
            self.advance(bisect_right(s, group, self.at[w], key=lambda k: k[:size]))


def merge_top(runs: list[list[tuple]], n: int) -> list[tuple]:
    """The first ``n`` distinct items of every group from sorted runs of (0 or 1 for null, group, -score, item)."""
    while len(runs) > FAN_IN:
        runs = [merge_top(runs[i : i + FAN_IN], n) for i in range(0, len(runs), FAN_IN)]
    tree, out = LoserTree(runs), []
    while (head := tree.head) is not LoserTree.END:
        group, seen = head[:2], set()
        while head[:2] == group:
            if head[3] not in seen:
                seen.add(head[3])
                out.append(head)
                if len(seen) == n:
                    tree.skip_group(group)
                    break
            tree.advance()
            head = tree.head
    return out


def _runs(n: int, buckets: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.append_column("__null", pc.cast(pc.is_null(t["group"]), pa.int8()))
            t = t.sort_by([("bucket", "ascending"), ("__null", "ascending"), ("group", "ascending"), ("score", "descending"), ("item", "ascending")])
            t = t.combine_chunks()
            g = pc.dictionary_encode(t["group"], null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
            item = pc.dictionary_encode(t["item"]).combine_chunks().indices.to_numpy(zero_copy_only=False)
            # the first row of every item of a group has its best score
            code = g.astype(np.int64) * (int(item.max()) + 1) + item
            _, first = np.unique(code, return_index=True)
            first.sort()
            groups = g[first]
            begin = np.concatenate([[True], groups[1:] != groups[:-1]])
            starts = np.flatnonzero(begin)
            place = np.arange(len(groups)) - starts[np.cumsum(begin) - 1]
            t = t.take(pa.array(first[place < n]))
            bucket = t["bucket"].to_numpy()
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            inside = np.arange(len(bucket)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            cuts = np.append(np.flatnonzero(inside % RECORD == 0), len(bucket)).astype(np.int32)
            heads = pa.array(cuts[:-1])
            columns = [pa.array(bucket[cuts[:-1]], pa.int32()), *[t[c].take(heads).combine_chunks() for c in ("group", "score", "item")]]
            for name in ("group", "score", "item"):
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), t[name].combine_chunks()))
            yield pa.Table.from_arrays(columns, out.names).cast(out).combine_chunks().to_batches()[0]

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= RUN_ROWS:
                    yield from emit(held)
                    held, rows = [], 0
        if held:
            yield from emit(held)

    return run


class Merger:
    """Merges records that come in the order of their first entries, and keeps ``n`` distinct items of every group."""

    def __init__(self, n: int) -> None:
        self.n, self.tree = n, LoserTree([])
        self.group: tuple | None = None
        self.seen: set = set()

    def add(self, keys: list[tuple]) -> list[tuple]:
        """Take a record in; gives (group, -score, item, rank) of what comes before its first entry."""
        out = self.drain(keys[0])
        # a group that is full already is passed over in what is still to come
        at = bisect_right(keys, self.group, key=lambda k: k[:2]) if len(self.seen) == self.n else 0
        left = [(s, i) for s, i in zip(self.tree.sources, self.tree.at, strict=True) if i < len(s)]
        if at < len(keys):
            left.append((keys, at))
        self.tree = LoserTree([s for s, _ in left], [i for _, i in left])
        return out

    def drain(self, bound: tuple = LoserTree.END) -> list[tuple]:
        """What comes before ``bound``."""
        tree, out = self.tree, []
        while (head := tree.head) < bound:
            if head[:2] != self.group:
                self.group, self.seen = head[:2], set()
            if head[3] not in self.seen:
                self.seen.add(head[3])
                out.append((*head, len(self.seen)))
                if len(self.seen) == self.n:
                    tree.skip_group(self.group)
                    continue
            tree.advance()
        return out


def _merge(n: int, out: pa.Schema):
    def batch(part: list[tuple]) -> pa.RecordBatch:
        columns = [[None if k[0] else k[1] for k in part], [k[3] for k in part], [0.0 - k[2] for k in part], [k[4] for k in part]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, bucket, found = Merger(n), None, []
        for b in batches:
            for at, g, s, i in zip(*[b.column(c) for c in ("bucket", "group", "score", "item")], strict=True):
                if bucket is not None and at.as_py() != bucket:
                    found += merger.drain()
                    merger = Merger(n)
                bucket = at.as_py()
                groups, scores, items = g.values.to_pylist(), s.values.to_numpy(zero_copy_only=False), i.values.to_pylist()
                found += merger.add([(0, x, y, z) if x is not None else (1, 0, y, z) for x, y, z in zip(groups, (-scores).tolist(), items, strict=True)])
                if len(found) >= 50_000:
                    yield batch(found)
                    found = []
        found += merger.drain()
        for a in range(0, len(found), 100_000):
            yield batch(found[a : a + 100_000])

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, buckets: int | None = None) -> DataFrame:
    """Columns ``group``, ``item``, ``score`` and rank (from 1): the ``n`` best items of every group.

    Order is score descending, then item ascending by code point. An item counts once in a group, with its highest score.
    Rows with null item or a score that is null or not a number are out; -0.0 equals 0.0; a null group is a group. Groups
    with fewer items keep all. Other columns of ``df`` don't matter. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship(spark)
    kinds = {f.name: f.dataType for f in df.select(group, item).schema.fields}
    rows = df.select(
        F.col(group).alias("group"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("score"),
        F.col(item).alias("item"),
        F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)).cast("int").alias("bucket"),
    ).where("item is not null and score is not null and not isnan(score)")
    stored = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("first_group", kinds[group]),
            T.StructField("first_score", T.DoubleType()),
            T.StructField("first_item", kinds[item]),
            T.StructField("group", T.ArrayType(kinds[group])),
            T.StructField("score", T.ArrayType(T.DoubleType())),
            T.StructField("item", T.ArrayType(kinds[item])),
        ]
    )
    result = T.StructType(
        [
            T.StructField(group, kinds[group]),
            T.StructField(item, kinds[item]),
            T.StructField(score, T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    runs = materialise(rows.mapInArrow(_runs(n, buckets, to_arrow_schema(stored)), stored), "runs")
    order = ["bucket", F.asc_nulls_last("first_group"), F.desc("first_score"), "first_item"]
    return runs.repartition(buckets, "bucket").sortWithinPartitions(*order).mapInArrow(_merge(n, to_arrow_schema(result)), result)
