"""Queries of the general data problems: p4 (heavy keys) and p5 (references without a record)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import canonical_id
from graphloom.operators.heavy_keys import heavy_keys, per_key
from graphloom.operators.orphans import Children, Parents, orphan_references, orphan_report
from graphloom.plans.registry import Registry
from graphloom.sources import table

QUERIES = Registry()
#: An id is heavy if it holds at least 1 in so many of the distinct edges.
HEAVY_ONE_IN = 100


def sql_id(c: str) -> str:
    """The canonical id of column ``c`` in SQL."""
    digits = rf"regexp_replace(lower(trim({c})), '^(0x)?0*([0-9a-f])', '\2')"
    return (
        f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{1,16}}') THEN lpad({digits}, 16, '0')"
        f" ELSE lower(trim({c})) END"
    )


def degrees(spark: SparkSession, root: str) -> DataFrame:
    """Per field and id the distinct edges, and the first and last of them."""
    ends = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("id")) for f in ("dst", "src")])
    long = (
        table(spark, root, "edges")
        .select("edge_id", F.explode(ends).alias("e"))
        .where("e.id is not null")
        .select("e.field", canonical_id(F.col("e.id")).alias("node_id"), "edge_id")
    )
    aggs = {"edges": ("edge_id", "count"), "first_edge": ("edge_id", "min"), "last_edge": ("edge_id", "max")}
    return per_key(long, ["field", "node_id"], ["edge_id"], aggs)


_LONG = " UNION ALL ".join(
    f"SELECT DISTINCT '{f}' AS field, {sql_id(f)} AS node_id, edge_id FROM edges WHERE {f} IS NOT NULL" for f in ("dst", "src")
)


@QUERIES.add(
    "p4_found",
    f"""WITH l AS ({_LONG}), t AS (SELECT field, count(DISTINCT edge_id) AS n FROM l GROUP BY field)
    SELECT l.field, node_id FROM l JOIN t USING (field) GROUP BY l.field, node_id, n
    HAVING count(DISTINCT edge_id) * 100 >= n""",
)
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return heavy_keys(degrees(spark, root), "field", "edges", HEAVY_ONE_IN).select("field", "node_id")


@QUERIES.add(
    "p4_degrees",
    f"""WITH l AS ({_LONG}) SELECT field, node_id, count(DISTINCT edge_id) AS edges, min(edge_id) AS first_edge,
    max(edge_id) AS last_edge FROM l GROUP BY field, node_id""",
)
def p4_degrees(spark: SparkSession, root: str) -> DataFrame:
    return degrees(spark, root)


_REFERENCES = [
    ("edges", "edge_id", "dst"),
    ("unresolved_calls", "call_id", "from_id"),
    ("unresolved_refs", "ref_id", "from_id"),
    ("unresolved_refs", "ref_id", "from_module"),
]


def orphans(spark: SparkSession, root: str) -> DataFrame:
    children = [Children(table(spark, root, t), t, i, f, canonical_id(F.col(f)), "loaded_at") for t, i, f in _REFERENCES]
    parents = [
        Parents(table(spark, root, t), canonical_id(F.col("id")), "added_at", "removed_at") for t in ("nodes", "shared_nodes")
    ]
    return orphan_references(children, parents)


_CHILD = " UNION ".join(
    f"SELECT '{t}' AS table_name, {i} AS row_id, '{f}' AS field, {sql_id(f)} AS k, loaded_at AS t FROM {t} WHERE {f} IS NOT NULL"
    for t, i, f in _REFERENCES
)
_PARENT = " UNION ".join(f"SELECT {sql_id('id')} AS k, added_at AS a, removed_at AS z FROM {t}" for t in ("nodes", "shared_nodes"))
_ORPHANS = f"""c AS ({_CHILD}), p AS ({_PARENT}), o AS (SELECT table_name, row_id, field, t FROM c LEFT JOIN p ON c.k = p.k
    GROUP BY table_name, row_id, field, t
    HAVING CASE WHEN t IS NULL THEN count(p.k) = 0 ELSE count(CASE WHEN a <= t AND (z IS NULL OR t < z) THEN 1 END) = 0 END)"""


@QUERIES.add("p5_found", f"WITH {_ORPHANS} SELECT table_name, row_id, field FROM o")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans(spark, root).select("table_name", "row_id", "field")


@QUERIES.add(
    "p5_report",
    f"""WITH {_ORPHANS} SELECT table_name, field, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans
    FROM o GROUP BY ALL""",
)
def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(orphans(spark, root))
