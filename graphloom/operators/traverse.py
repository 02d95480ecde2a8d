"""Walks over the graph: bounded traversal, reachability, containment, personalised PageRank.

Every level of a walk is one join of the edges with the frontier. Levels are written to the shared folder, so plans stay
short and a lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.schema import weight
from graphloom.session import materialise


def walk(edges: DataFrame, seeds: DataFrame, depth: int, categories: list[int] | None = None, backward: bool = False) -> DataFrame:
    """Ids reached from ``seeds`` (id) in at most ``depth`` steps, with the steps needed; the seeds themselves are out.

    An empty list of categories follows nothing, None follows all. Loops and cycles end by themselves.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = edges.where("src is not null and dst is not null")
    if categories is not None:
        steps = steps.where(F.col("category").isin(*categories) if categories else F.lit(False))
    steps = steps.select(F.col(a).alias("id"), F.col(b).alias("to")).distinct()
    steps = materialise(steps, "steps")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, levels = seen, [seen]
    for k in range(1, depth + 1):
        reached = frontier.join(steps, "id").select(F.col("to").alias("id")).distinct()
        new = reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k))
        frontier = materialise(new, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = reduce(DataFrame.unionByName, levels)
    return seen.where("depth > 0")


def reachable_by(edges: DataFrame, sinks: DataFrame, sources: DataFrame, depth: int, categories: list[int] | None = None) -> DataFrame:
    """Which ``sources`` reach one of ``sinks``, and in how many steps; a sink itself never counts."""
    return walk(edges, sinks, depth, categories, backward=True).join(sources.select("id").distinct(), "id", "left_semi")


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """What a change of ``seeds`` reaches over all edges: depth, and the category of the first edge that gets there."""
    found = seeds.select("id").distinct().withColumn("depth", F.lit(0)).unionByName(walk(edges, seeds, depth))
    found = materialise(found, "impact")
    before = found.select(F.col("id").alias("src"), F.col("depth").alias("d"))
    at = found.where("depth > 0").select(F.col("id").alias("dst"), "depth")
    via = edges.join(before, "src").join(at, "dst").where("depth = d + 1")
    return via.groupBy(F.col("dst").alias("id")).agg(
        F.min("depth").alias("depth"), F.min_by("category", F.struct("edge_id")).alias("category")
    )


def parent_chain(nodes: DataFrame) -> DataFrame:
    """Each node's ancestors by containment, from its parent up to the top, as far as they are nodes.

    Every step climbs as far as all steps before it together, so a chain of n ancestors takes about log2(n) of them. A cycle
    of containment has no top; its nodes come once each, and the node itself isn't its own ancestor.
    """
    up = nodes.where("parent_id is not null and parent_id <> id").select("id", F.col("parent_id").alias("ancestor"))
    known = up.join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", F.lit(1).alias("depth"))
    known = materialise(known.distinct(), "ancestors")
    reach, size = 1, known.count()
    while True:
        # ancestors at exactly ``reach`` steps, and what is known above them
        last = known.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("via"))
        above = known.select(F.col("id").alias("via"), F.col("ancestor"), (F.col("depth") + reach).alias("depth"))
        more = last.join(above, "via").where("ancestor <> id").select("id", "ancestor", "depth")
        # a node that comes again lies on a cycle; the nearest place counts
        found = known.unionByName(more).groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        found = materialise(found, "ancestors")
        n = found.count()
        if n == size:
            return found
        known, reach, size = found, 2 * reach, n


def activate(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, profile: str = "default", damping: float = 0.5,
    direction: str = "forward", rounds: int = 100, epsilon: float | None = 1e-6, specificity: str = "none", top: int | None = None,
) -> DataFrame:
    """Personalised PageRank from ``seeds`` over the edges between ``nodes``: id and score above 0.

    Parallel edges add their weights, and edges whose weight is 0 or less are out. Seeds that repeat lower the mass that
    starts. Mass at nodes without a way out returns to the seeds. Rounds end when scores change by less than ``epsilon``
    in sum. ``specificity`` idf divides by 1 + degree, inverse_idf multiplies with ln(2 + degree).
    """
    damping = min(0.99, max(0.01, damping))
    ids = nodes.select("id").distinct()
    arcs = edges.select("src", "dst", weight(F.col("category"), profile).alias("w")).where("w > 0")
    arcs = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    arcs = {"forward": arcs, "backward": back}.get(direction) or arcs.unionByName(back) if direction != "undirected" else arcs.unionByName(back)
    arcs = arcs.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = arcs.groupBy("src").agg(F.sum("w").alias("total"))
    arcs = materialise(arcs.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")), "arcs")
    ways = materialise(out.select(F.col("src").alias("id"), F.lit(1.0).alias("way")), "ways")
    s = seeds.count()
    start = seeds.select("id").distinct().join(ids, "id", "left_semi").withColumn("p", F.lit(1.0 / max(1, s)))
    start = materialise(start, "seeds")
    v = start.select("id", F.col("p").alias("v"))
    stuck = v.join(ways, "id", "left_anti").agg(F.sum("v")).first()[0] or 0.0
    part = lambda df, v, old=F.lit(0.0), way=F.lit(0.0): df.select("id", v.alias("v"), old.alias("old"), way.alias("way"))
    for k in range(rounds):
        moved = v.join(arcs, v.id == arcs.src).select(F.col("dst").alias("id"), (F.col("v") * F.col("w") * damping).alias("v"))
        home = part(start, F.col("p") * (1 - damping + damping * stuck))
        # one grouping adds the scores up and tells what has changed and what has no way out, seen as the table is written
        rows = reduce(DataFrame.unionByName, [part(moved, F.col("v")), home, part(v, F.lit(0.0), F.col("v")), part(ways, F.lit(0.0), way=F.col("way"))])
        new = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("v", "old", "way")])
        seen = Observation(f"round-{k}")
        new = new.observe(seen, F.sum(F.abs(F.col("v") - F.col("old"))).alias("change"), F.sum(F.when(F.col("way") == 0, F.col("v"))).alias("stuck"))
        v = materialise(new.where("v > 0").select("id", "v"), "scores")
        change, stuck = seen.get["change"] or 0.0, seen.get["stuck"] or 0.0
        if epsilon is not None and change < epsilon:
            break
    if specificity != "none":
        pairs = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        d = F.coalesce("d", F.lit(0))
        scaled = F.col("v") / (1 + d) if specificity == "idf" else F.col("v") * F.log1p(1.0 + d)
        v = v.join(degree, "id", "left").select("id", scaled.alias("v"))
    scores = v.where("v > 0").select("id", F.col("v").alias("score"))
    return scores.orderBy(F.desc("score"), "id").limit(top) if top else scores
