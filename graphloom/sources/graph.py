"""The property graph behind the domain tables: one row per node, edge and cell, ids and confidence in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import canonical_id
from graphloom.schema import confidence, confidence_sql
from graphloom.sources import table

NODE = ["repo_id", "kind", "name", "qname", "parent_id", "confidence", "file", "start_line", "end_line"]


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """Each node as in its latest life; of lives that begin together the one still open counts, then the later end."""
    rows = table(spark, root, "nodes").select(
        canonical_id(F.col("id")).alias("id"),
        F.struct(
            "repo_id", "kind", "name", "qname", canonical_id(F.col("parent_id")).alias("parent_id"),
            confidence(F.col("confidence")).alias("confidence"), "file", "start_line", "end_line",
        ).alias("n"),
        F.struct("added_at", F.col("removed_at").isNull().alias("open"), "removed_at").alias("life"),
    )
    return rows.groupBy("id").agg(F.max_by("n", "life").alias("n")).select("id", *[f"n.{c}" for c in NODE])


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Each edge once; edges without an end are kept, with a null there."""
    return (
        table(spark, root, "edges")
        .select(
            "edge_id", "repo_id", canonical_id(F.col("src")).alias("src"), canonical_id(F.col("dst")).alias("dst"),
            "category", confidence(F.col("confidence")).alias("confidence"), "intra",
        )
        .dropDuplicates(["edge_id"])
    )


def shared_nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "shared_nodes").select(canonical_id(F.col("id")).alias("id"), "kind", "name", "qname").dropDuplicates(["id"])


def cells(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "cells")
        .select(canonical_id(F.col("node_id")).alias("node_id"), "ord", "cell_type", "payload_type", "text")
        .distinct()
    )


def files(spark: SparkSession, root: str) -> DataFrame:
    """Files without their source, each once."""
    return table(spark, root, "files").select("file_id", "repo", "path", "lang").dropDuplicates(["file_id"])


def _sql_id(c: str) -> str:
    digits = rf"regexp_replace(lower(trim({c})), '^(0x)?0*([0-9a-f])', '\2')"
    return f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{1,16}}') THEN lpad({digits}, 16, '0') ELSE lower(trim({c})) END"


#: The same as common table expressions: n, e, s, c and f.
SQL = {
    "n": f"""n AS (SELECT id, repo_id, kind, name, qname, parent_id, confidence, file, start_line, end_line FROM (SELECT {_sql_id("id")} AS id,
      repo_id, kind, name, qname, {_sql_id("parent_id")} AS parent_id, {confidence_sql("confidence")} AS confidence, file, start_line, end_line,
      row_number() OVER (PARTITION BY {_sql_id("id")} ORDER BY added_at DESC, removed_at IS NULL DESC, removed_at DESC) AS rn FROM nodes) WHERE rn = 1)""",
    "e": f"""e AS (SELECT DISTINCT edge_id, repo_id, {_sql_id("src")} AS src, {_sql_id("dst")} AS dst, category,
      {confidence_sql("confidence")} AS confidence, intra FROM edges)""",
    "s": f"s AS (SELECT DISTINCT {_sql_id('id')} AS id, kind, name, qname FROM shared_nodes)",
    "c": f"c AS (SELECT DISTINCT {_sql_id('node_id')} AS node_id, ord, cell_type, payload_type, text FROM cells)",
    "f": "f AS (SELECT DISTINCT file_id, repo, path, lang FROM files)",
}


def ctes(names: str) -> str:
    return "WITH " + ", ".join(SQL[x] for x in names.split())
