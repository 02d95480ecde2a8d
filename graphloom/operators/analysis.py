"""Analysis of evaluation runs: pass rates, failure buckets, effect classes, overlap of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_at(p: Column, k: int) -> Column:
    """Chance that one of ``k`` tries passes when one passes with ``p``."""
    return 1.0 - F.pow(1.0 - p, F.lit(float(k)))


def tries_for(p: Column, quantile: float) -> Column:
    """Tries until one passes with probability ``quantile``: infinite at 0, one at 1."""
    return F.when(p <= 0, F.lit(float("inf"))).when(p >= 1, F.lit(1.0)).otherwise(F.log(F.lit(1.0 - quantile)) / F.log(1.0 - p))


def pass_rates(rows: DataFrame, key: str, passed: Column) -> DataFrame:
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("p"))
    return per.select(key, "n", F.round("p", 6).alias("p"), F.round(pass_at(F.col("p"), 5), 6).alias("pass_5"), F.round(tries_for(F.col("p"), 0.9), 4).alias("tries_90"))


def first_class(line: Column, classes: list[tuple[str, str]], other: str = "none") -> Column:
    """The first class whose pattern a line matches."""
    c = F.when(line.rlike(classes[0][1]), classes[0][0])
    for name, pattern in classes[1:]:
        c = c.when(line.rlike(pattern), name)
    return c.otherwise(other)


def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """Pairs (l, r) of ranges (key, id, a, z) that overlap, found by buckets of ``width`` that both touch.

    A pair that meets in several buckets is reported in the first of them only, so nothing has to be made distinct.
    """
    cover = lambda df: df.withColumn("b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("z") / width))))
    x = cover(left).select(*key, "b", F.col("id").alias("l"), F.col("a").alias("la"), F.col("z").alias("lz"))
    y = cover(right).select(*key, "b", F.col("id").alias("r"), F.col("a").alias("ra"), F.col("z").alias("rz"))
    both = x.join(y, [*key, "b"]).where("la <= rz and ra <= lz")
    return both.where(F.col("b") == F.floor(F.greatest("la", "ra") / width)).select(*key, "l", "r")
