"""The registry of named queries: what ``__spark_entry__`` hands to its callers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """``run(spark, root)`` gives the result; ``sql`` is the same in ANSI SQL, or None where SQL can't express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None):
        def wrap(run):
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Query(run, sql)
            return run

        return wrap
