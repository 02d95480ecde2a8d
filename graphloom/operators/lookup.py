"""Lookups, primary picks and induced subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """Edges that touch each id; a loop counts once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def specificity(edges: DataFrame) -> DataFrame:
    """Ends of edges at each id; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def pick_primary(candidates: DataFrame, key: list[str], degree: DataFrame) -> DataFrame:
    """Of the candidates (key, id) of each key the one of the highest degree, then the lowest id."""
    best = F.min_by("id", F.struct(-F.coalesce("degree", F.lit(0)), F.col("id")))
    return candidates.join(degree, "id", "left").groupBy(*key).agg(best.alias("id"), F.count("*").alias("candidates"))


def resolve_span(spans: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """A dotted span's node: of the exact qualified name, else of one that ends in it, in either tier the primary one.

    Suffixes are matched by equality on as many last segments as the span has, never by a scan over all pairs.
    """
    wanted = spans.select("span", F.replace("span", F.lit("."), F.lit("::")).alias("q")).distinct()
    wanted = wanted.withColumn("n", F.size(F.split("q", "::")))
    sizes = [r.n for r in wanted.select("n").distinct().orderBy("n").collect()]  # as many as spans have segments
    parts = F.split("qname", "::")
    ends = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "::")) for n in sizes]) if sizes else F.array()
    keyed = nodes.select("id", "qname", F.explode(F.array_distinct(F.array_compact(ends))).alias("q"))
    found = wanted.join(keyed, "q").withColumn("tier", F.when(F.col("qname") == F.col("q"), 0).otherwise(1))
    first = W.partitionBy("span").orderBy("tier", F.coalesce("degree", F.lit(0)).desc(), "id")
    return found.join(degree, "id", "left").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("span", "id", "qname")


def induced(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that ``keep`` holds for, and the edges with both ends among them."""
    kept = nodes.where(keep)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


def unique_or_nothing(nodes: DataFrame, key: list[str]) -> DataFrame:
    """The id of every key that only one node has."""
    return nodes.groupBy(*key).agg(F.min("id").alias("id"), F.max("id").alias("__last")).where("id = __last").drop("__last")
