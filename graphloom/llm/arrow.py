"""Running Python over Arrow batches of a few columns."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.session import ship


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; a scan of enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """``make()`` once a task gives a function of a row's columns that returns rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # parsing makes many objects that don't refer to each other; looking for cycles among them is wasted
        gc.set_threshold(100_000, 50, 50)
        rows_of = make()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.extend(rows_of(*row))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, kind)
