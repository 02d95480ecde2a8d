"""Passes over a merged graph: test edges, confidence, provenance, inheritance, chains of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import is_noncritical, is_test_qname, strip_test_affixes, tail
from graphloom.operators.traverse import walk

#: Modules that one test module tests at most.
MOST_TARGETS = 3


def test_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) from test modules to the modules of their name without the test's affixes.

    Of several modules those count that share the longest start of the path, at most three of them by id.
    """
    modules = nodes.where("kind = 1 and qname is not null").select("id", "qname", tail(F.col("qname")).alias("tail"))
    tests = modules.where(is_test_qname(F.col("qname"))).select(
        F.col("id").alias("src"), F.col("qname").alias("tq"), strip_test_affixes(F.col("tail")).alias("name"), "tail"
    ).where("name <> '' and name <> tail").drop("tail")
    above = lambda c: F.slice(F.split(c, "::"), F.lit(1), F.size(F.split(c, "::")) - 1)
    same = F.transform(F.arrays_zip(above("tq").alias("a"), above("qname").alias("b")), lambda p: F.coalesce(p.a == p.b, F.lit(False)))
    first = F.array_position(same, False)
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    pairs = tests.join(modules.select(F.col("id").alias("dst"), "qname", F.col("tail").alias("name")), "name").where("src <> dst")
    scored = pairs.select("src", "dst", shared.alias("shared"))
    order = W.partitionBy("src").orderBy(F.desc("shared"), "dst")
    best = scored.withColumn("top", F.max("shared").over(W.partitionBy("src"))).withColumn("k", F.row_number().over(order))
    return best.where(f"shared = top and k <= {MOST_TARGETS}").select("src", "dst")


def settle_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, kind, qname, confidence) with the confidence after all passes.

    What lies below tests, fixtures and examples is Weak, but for routes by name; routes and endpoints that no HTTP edge
    touches are Medium at most.
    """
    touched = edges.where("category = 10").select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct().withColumn("touched", F.lit(True))
    weak = ~F.col("qname").startswith("route:") & is_noncritical(F.col("qname"))
    first = F.when(F.coalesce(weak, F.lit(False)), "Weak").otherwise(F.col("confidence"))
    alone = F.col("kind").isin(5, 9) & F.col("touched").isNull()
    rows = nodes.join(touched, "id", "left").withColumn("c", first)
    return rows.select("id", "kind", "qname", F.when((F.col("c") != "Weak") & alone, "Medium").otherwise(F.col("c")).alias("confidence"))


def provenance(nodes: DataFrame, cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes (id, repo, kind, qname, file) with where they come from: (id, provenance).

    A node's own ORIGIN cell counts first; then dependencies and shared entities by kind or a qualified name that names no
    file (``package:``, ``external:``); then what a node's file says: the deepest region (repo, prefix, provenance) above it,
    generated by name, or authored. A node without a file is synthetic.
    """
    own = cells.where("cell_type = 15").groupBy(F.col("node_id").alias("id")).agg(F.min(F.get_json_object("text", "$.provenance")).alias("own"))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = nodes.where("file is not null").select("repo", "file").distinct().select("repo", "file", F.posexplode(above).alias("depth", "prefix"))
    deepest = dirs.join(regions, ["repo", "prefix"]).groupBy("repo", "file").agg(F.max_by("provenance", "depth").alias("region"))
    rows = nodes.join(own, "id", "left").join(deepest, ["repo", "file"], "left")
    generated = F.col("file").rlike(r"\.pb\.|_pb2(_grpc)?\.py$|\.g\.dart$|\.gen\.|_generated\.|\.min\.js$")
    found = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("kind").isin(6, 40) | F.col("qname").rlike("^(package|external):"), "dependency")
        .when(F.col("file").isNull(), "synthetic")
        .when(F.col("region").isNotNull(), F.col("region"))
        .when(generated, "generated")
        .otherwise("authored")
    )
    return rows.select("id", found.alias("provenance"))


def ancestors(edges: DataFrame, types: DataFrame, depth: int = 64) -> DataFrame:
    """All types that each of ``types`` (id) inherits from, over INHERITS_FROM edges: (id, ancestor).

    Pairs grow along shared ancestors, never through a type twice; ``depth`` bounds the length of one line of inheritance.
    """
    up = edges.where("category = 20 and src is not null and dst is not null and src <> dst").select(F.col("src").alias("via"), F.col("dst").alias("ancestor")).distinct()
    from graphloom.session import materialise

    up = materialise(up, "inherits")
    known = materialise(types.select(F.col("id").alias("via")).distinct().join(up, "via").select(F.col("via").alias("id"), "ancestor"), "ancestors")
    frontier = known
    for _ in range(depth):
        more = frontier.withColumnRenamed("ancestor", "via").join(up, "via").select("id", "ancestor").where("id <> ancestor").distinct()
        frontier = materialise(more.join(known, ["id", "ancestor"], "left_anti"), "ancestors")
        if frontier.isEmpty():
            return known
        known = materialise(known.unionByName(frontier), "ancestors")
    return known


def call_chains(edges: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """What anchors (anchor) call, directly and through others: (anchor, id, depth), each at its least depth."""
    from graphloom.session import materialise

    calls = materialise(edges.where("category = 4 and src is not null and dst is not null").select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct(), "calls")
    known = anchors.select("anchor", F.col("anchor").alias("id"), F.lit(0).alias("depth")).distinct()
    frontier = known
    for k in range(1, depth + 1):
        reached = frontier.join(calls, "id").select("anchor", F.col("to").alias("id")).distinct()
        frontier = materialise(reached.join(known, ["anchor", "id"], "left_anti").withColumn("depth", F.lit(k)), "chain")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.where("depth > 0")


def handlers_reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """How many ids lie at each number of steps from ``seeds`` over calls: (depth, ids)."""
    return walk(edges, seeds, 8, [4]).groupBy("depth").agg(F.count("*").alias("ids"))
