"""Rows as text: prose, dense topology, Mermaid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schema import CATEGORIES, KINDS, named


def prose(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """One line per node, ``KIND qname [file:a-b]``, and up to three lines of its documentation, else of its code."""
    text = cells.where("cell_type in (1, 2)").groupBy(F.col("node_id").alias("id")).agg(
        F.max_by("text", F.struct(F.col("cell_type"), -F.col("ord"))).alias("body")
    )
    where = F.when(F.col("file").isNotNull() & F.col("start_line").isNotNull(), F.concat(F.lit(" ["), "file", F.lit(":"), F.col("start_line") + 1, F.lit("-"), F.col("end_line") + 1, F.lit("]")))
    head = F.concat(named(F.col("kind"), KINDS), F.lit(" "), F.col("qname"), F.coalesce(where, F.lit("")))
    lines = F.slice(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""), 1, 3)
    body = F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), F.trim(x))), "\n")))
    return nodes.join(text, "id", "left").select("id", F.concat(head, F.coalesce(body, F.lit(""))).alias("text"))


def topology(nodes: DataFrame, edges: DataFrame, categories: tuple[int, ...] = (4, 9, 10)) -> DataFrame:
    """Distinct lines ``from -CATEGORY-> to`` of the edges that tell how a program runs."""
    n = nodes.select("id", "qname")
    pairs = edges.where(F.col("category").isin(*categories)).select("src", "dst", "category").distinct()
    a, b = n.select(F.col("id").alias("src"), F.col("qname").alias("a")), n.select(F.col("id").alias("dst"), F.col("qname").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select(F.concat("a", F.lit(" -"), named(F.col("category"), CATEGORIES), F.lit("-> "), "b").alias("line")).distinct()


def mermaid(service_edges: DataFrame) -> str:
    """A Mermaid chart of edges (from, to, label), which the number of services bounds."""
    lines = [f"  {r[0]} -->|{r[2]}| {r[1]}" for r in sorted(map(tuple, service_edges.collect()))]
    return "\n".join(["graph LR", *lines])


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node and edge as one line of JSON; lines count from 1."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.col(c).cast("int") + 1).alias(c)
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), "id", named(F.col("kind"), KINDS).alias("kind"), "name", "qname", "file", one("start_line"), one("end_line"))).alias("json"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), "src", "dst", named(F.col("category"), CATEGORIES).alias("category"), "confidence", "intra")).alias("json"))
    return n.unionByName(e)
