"""Per-key results without a task that is far slower than the rest, however skewed the keys are.

The rows are range partitioned on the composite of key and secondary order, with quantiles that Spark samples from the
data. Since the order is part of the range, a heavy key is cut into as many partitions as its rows fill. Every partition
reduces its sorted rows to one state per key; only a partition's first and last key can go on in a neighbour, so only
those states are stitched, two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialise, ship

#: How states of two pieces of one key are joined.
STITCH = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _reducer(keys: list[str], order: list[str], aggs: list[tuple[str, str, str]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        def changed(batch: pa.RecordBatch, names: list[str], last: pa.RecordBatch | None):
            """Whether each row differs from the row before it in one of the columns; nulls are equal to each other."""
            out = np.zeros(batch.num_rows, bool)
            out[0] = last is None
            for n in names:
                col = batch.column(n)
                if last is not None:
                    col = pa.concat_arrays([last.column(n), col])
                a, b = col.slice(0, len(col) - 1), col.slice(1)
                differs = pc.if_else(
                    pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.xor(pc.is_valid(a), pc.is_valid(b))
                ).to_numpy(zero_copy_only=False)
                out[0 if last is not None else 1 :] |= differs.astype(bool)
            return out

        last, held, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new_key = changed(batch, keys, last)
            fresh = new_key | changed(batch, order, last)
            last = batch.slice(batch.num_rows - 1, 1)
            starts = np.flatnonzero(new_key)
            group = np.cumsum(new_key) - (1 if new_key[0] else 0)
            kept = batch.filter(pa.array(fresh))
            table = pa.table({**{n: kept.column(n) for n in kept.schema.names}, "__g": group[fresh]})
            spec = [(c, "count" if how == "count" else how) for _, c, how in aggs]
            agg = table.group_by("__g", use_threads=False).aggregate(spec)
            # group 0 may have no fresh row when it goes on from the batch before
            total = int(group[-1]) + 1
            at = np.full(total, -1)
            at[agg.column("__g").to_numpy()] = np.arange(agg.num_rows)
            begin = starts if new_key[0] else np.concatenate([[0], starts])
            states = {k: batch.column(k).take(pa.array(begin)) for k in keys}
            take = pa.array(at, mask=at < 0)
            for name, c, how in aggs:
                col = agg.column(f"{c}_{how}").combine_chunks()
                states[name] = col.take(take)
            piece = pa.table(states)
            if held is not None and not new_key[0]:
                merged = {k: held.column(k) for k in keys}
                for name, _, how in aggs:
                    both = pa.concat_arrays([held.column(name).combine_chunks(), piece.column(name).slice(0, 1).combine_chunks()])
                    merged[name] = pa.array([{"count": pc.sum, "sum": pc.sum, "min": pc.min, "max": pc.max}[how](both).as_py()], both.type)
                piece = pa.concat_tables([pa.table(merged), piece.slice(1)])
            elif held is not None:
                piece = pa.concat_tables([held, piece])
            held = piece.slice(piece.num_rows - 1)
            done = piece.slice(0, piece.num_rows - 1)
            if done.num_rows:
                edge = np.zeros(done.num_rows, bool)
                edge[0], first = first, False
                yield from done.append_column("__edge", pa.array(edge)).cast(schema).to_batches()
        if held is not None:
            yield from held.append_column("__edge", pa.array([True])).cast(schema).to_batches()

    return run


def per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    partitions: int | None = None,
) -> DataFrame:
    """One row per key: its columns and ``aggs`` (name to column and one of count, sum, min, max).

    Rows equal in keys and ``order`` are one record and count once. Nulls in a key are a key of their own; nulls in an
    aggregated column are passed over, a key with nothing else has a null sum, min or max and a count of 0. An empty
    table gives no rows; columns that aren't named don't matter, whatever their names.
    """
    keys, order = list(keys), list(order)
    named = [(n, c, how) for n, (c, how) in aggs.items()]
    if bad := [how for _, _, how in named if how not in STITCH]:
        raise ValueError(f"no such aggregate: {bad[0]}")
    used = list(dict.fromkeys([*keys, *order, *(c for _, c, _ in named)]))
    rows = df.select(*used)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [
            T.StructField(
                n,
                T.LongType()
                if how == "count" or how == "sum" and isinstance(kinds[c], T.IntegralType)
                else T.DoubleType()
                if how == "sum"
                else kinds[c],
            )
            for n, c, how in named
        ]
        + [T.StructField("__edge", T.BooleanType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    composite = [F.col(c) for c in [*keys, *order]]
    spread = rows.repartitionByRange(*([partitions] if partitions else []), *composite)
    states = spread.sortWithinPartitions(*composite).mapInArrow(_reducer(keys, order, named, to_arrow_schema(out)), out)
    states = materialise(states, "key-states")
    inner = states.where(~F.col("__edge")).drop("__edge")
    ends = states.where("__edge").groupBy(*keys).agg(*[STITCH[how](n).alias(n) for n, _, how in named])
    return inner.unionByName(ends)


def heavy_keys(counts: DataFrame, within: str, count: str, one_in: int) -> DataFrame:
    """The rows of ``counts`` that hold at least 1 in ``one_in`` of the sum of ``count`` over their ``within``."""
    totals = counts.groupBy(within).agg(F.sum(count).alias("__total"))  # a row for each value of within
    return counts.join(F.broadcast(totals), within).where(F.col(count) * one_in >= F.col("__total")).drop("__total")
