"""Resolvers: entities of different repositories joined by what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import normalise_http_path
from graphloom.schema import conf_rank, from_rank

# Leading segments of a path that a client may leave out or add.
OPTIONAL_SEGMENTS = ("protected", "api", "public", "internal", "v1", "v2", "v3")


def pair_across_repos(entities: DataFrame) -> DataFrame:
    """How many keys each two repositories share, of entities (repo, key, confidence).

    An entity counts once in a repository. Pairs are only made of the repositories of one key, which the number of
    repositories bounds, and counted at once.
    """
    once = entities.where("key is not null").groupBy("repo", "key").agg(F.max(conf_rank(F.col("confidence"))).alias("rank"))
    a = once.select("key", F.col("repo").alias("repo_a"), F.col("rank").alias("rank_a"))
    b = once.select("key", F.col("repo").alias("repo_b"), F.col("rank").alias("rank_b"))
    return (
        a.join(b, "key")
        .where("repo_a < repo_b")
        .groupBy("repo_a", "repo_b")
        .agg(F.count("*").alias("shared"), from_rank(F.min(F.least("rank_a", "rank_b"))).alias("weakest"))
    )


def match_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges from each ``left`` (id, repo, key, confidence) to each ``right`` of the same key in another repository."""
    a = left.select("key", F.col("id").alias("src"), F.col("repo").alias("ra"), conf_rank(F.col("confidence")).alias("ca"))
    b = right.select("key", F.col("id").alias("dst"), F.col("repo").alias("rb"), conf_rank(F.col("confidence")).alias("cb"))
    return a.join(b, "key").where("ra <> rb").select("src", "dst", from_rank(F.least("ca", "cb")).alias("confidence"))


def grpc_stack(clients: DataFrame, services: DataFrame) -> DataFrame:
    """Edges from clients to the services of other repositories that are what their key names before its first dot."""
    return match_by_key(clients.withColumn("key", F.substring_index("key", ".", 1)), services)


def http_stack(endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """Edges from endpoints to routes (id, repo, method, path, confidence) of the same method and normalised path.

    If no route has an endpoint's path, up to two optional leading segments are left out, one after the other; the first
    level with a hit counts. ``ANY`` is a method like any other.
    """
    parts = F.filter(F.split(normalise_http_path(F.col("path")), "/"), lambda x: x != "")
    optional = lambda i: F.try_element_at(parts, F.lit(i)).isin(*OPTIONAL_SEGMENTS)
    cut = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, 1 << 20), "/"))
    levels = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("level"), cut(0).alias("key")),
            F.when(optional(1), F.struct(F.lit(1).alias("level"), cut(1).alias("key"))),
            F.when(optional(1) & optional(2), F.struct(F.lit(2).alias("level"), cut(2).alias("key"))),
        )
    )
    a = endpoints.select(
        F.col("id").alias("src"), F.col("repo").alias("ra"), F.upper("method").alias("method"), conf_rank(F.col("confidence")).alias("ca"), F.explode(levels).alias("l")
    ).select("src", "ra", "method", "ca", "l.level", "l.key")
    b = routes.select(
        F.col("id").alias("dst"), F.col("repo").alias("rb"), F.upper("method").alias("method"),
        normalise_http_path(F.col("path")).alias("key"), conf_rank(F.col("confidence")).alias("cb"),
    )
    hits = a.join(b, ["method", "key"]).where("ra <> rb")
    best = hits.withColumn("first", F.min("level").over(W.partitionBy("src")))
    return best.where("level = first").select("src", "dst", "level", from_rank(F.least("ca", "cb")).alias("confidence")).distinct()


def contains_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (src, dst) of which one lower-case key contains the other, as GraphQL operations meet resolvers.

    A key that lies in another begins with one of the other's pieces of its length, three letters at most; so keys meet by
    equality on the first piece of the one and all pieces of the other. An empty key lies in every key. Null keys are out.
    """
    a = left.select(F.col("id").alias("src"), F.lower("key").alias("ka")).where("ka is not null")
    b = right.select(F.col("id").alias("dst"), F.lower("key").alias("kb")).where("kb is not null")

    def pieces(k: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1)))
        of = [F.transform(starts, lambda i: F.substring(k, i, F.lit(1))), F.transform(starts, lambda i: F.substring(k, i, F.lit(2))), F.transform(starts, lambda i: F.substring(k, i, F.lit(3)))]
        return F.array_distinct(F.concat(F.array(F.lit("")), *of))

    first = lambda k: F.substring(k, 1, 3)
    outer = a.withColumn("g", F.explode(pieces("ka"))).join(b.withColumn("g", first("kb")), "g").where(F.col("ka").contains(F.col("kb")))
    inner = b.withColumn("g", F.explode(pieces("kb"))).join(a.withColumn("g", first("ka")), "g").where(F.col("kb").contains(F.col("ka")))
    return outer.select("src", "dst").unionByName(inner.select("src", "dst")).distinct()


def suffix_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of which one trimmed lower-case path ends in the other, as WebSocket clients meet handlers.

    ``ws`` on either side and the handler ``default`` meet everything, and so does an empty path. Every suffix that
    begins at a slash, or is the whole, is a key; other suffixes are found by their whole text.
    """
    clean = lambda c: F.lower(F.trim(c))
    a = left.select(F.col("id").alias("src"), clean(F.col("key")).alias("ka")).where("ka is not null")
    b = right.select(F.col("id").alias("dst"), clean(F.col("key")).alias("kb")).where("kb is not null")
    wild_a, wild_b = F.col("ka").isin("ws", ""), F.col("kb").isin("ws", "default", "")
    ends = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.substring(k, i, F.length(k))))
    pa, pb = a.where(~wild_a), b.where(~wild_b)
    one = pa.withColumn("key", F.explode(ends(F.col("ka")))).join(pb.withColumn("key", F.col("kb")), "key").select("src", "dst")
    two = pa.withColumn("key", F.col("ka")).join(pb.withColumn("key", F.explode(ends(F.col("kb")))), "key").select("src", "dst")
    # wildcards meet everything by their meaning; the result has these pairs, so their number is that of the output
    any_ = a.join(b, wild_a | wild_b).select("src", "dst")
    return one.unionByName(two).unionByName(any_).distinct()


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets of call sites (call_id, from_id, shape, base, name) and by which rule they were found.

    A bare call means a symbol of the caller's module, a call on self a method of the caller's class, an attribute call a
    method of the class that its base names in the module; what is left means the only function or method of that name
    in the repository, if there is just one. Super and complex receivers stay unresolved.
    """
    n = nodes.select("id", "repo_id", "kind", "name", "qname", "file", "parent_id")
    caller = n.select(F.col("id").alias("from_id"), F.col("repo_id").alias("repo"), F.col("file").alias("at"), F.col("parent_id").alias("owner"))
    c = calls.join(caller, "from_id", "left")
    functions = n.where(F.col("kind").isin(3, 4))
    by_module = functions.groupBy(F.col("repo_id").alias("repo"), F.col("file").alias("at"), "name").agg(F.min("id").alias("module_hit"))
    by_class = functions.where("kind = 4").groupBy(F.col("parent_id").alias("owner"), "name").agg(F.min("id").alias("class_hit"))
    classes = n.where(F.col("kind").isin(2, 8)).groupBy(F.col("repo_id").alias("repo"), F.col("file").alias("at"), F.col("name").alias("base")).agg(F.min("id").alias("cls"))
    base_hit = by_class.select(F.col("owner").alias("cls"), "name", F.col("class_hit").alias("base_hit"))
    only = functions.groupBy(F.col("repo_id").alias("repo"), "name").agg(F.min("id").alias("only_hit"), F.max("id").alias("__l")).where("only_hit = __l").drop("__l")
    joined = (
        c.join(by_module, ["repo", "at", "name"], "left")
        .join(by_class, ["owner", "name"], "left")
        .join(classes, ["repo", "at", "base"], "left")
        .join(base_hit, ["cls", "name"], "left")
        .join(only, ["repo", "name"], "left")
    )
    s = F.col("shape")
    hit = F.when(s == "Bare", F.col("module_hit")).when(s == "SelfMethod", F.col("class_hit")).when(s == "Attribute", F.col("base_hit"))
    open_ = s.isin("Bare", "SelfMethod", "Attribute")
    return joined.select(
        "call_id",
        F.coalesce(hit, F.when(open_, F.col("only_hit"))).alias("dst"),
        F.when(hit.isNotNull(), "scope").when(open_ & F.col("only_hit").isNotNull(), "unique").otherwise("unresolved").alias("rule"),
    )


def frame_nodes(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """The narrowest node whose lines hold each frame (frame, path, line from 1), by the file's base name.

    Only nodes of the same base name are compared; of equally narrow ones the lowest id counts.
    """
    spans = nodes.where("file is not null and start_line is not null").select(
        F.regexp_extract("file", r"([^/\\]*)$", 1).alias("base"), "id", F.col("start_line").alias("a"), F.col("end_line").alias("z")
    )
    f = frames.withColumn("base", F.regexp_extract("path", r"([^/\\]*)$", 1))
    hits = f.join(spans, "base").where("line - 1 between a and z")
    return hits.groupBy("frame").agg(F.min_by("id", F.struct(F.col("z") - F.col("a"), F.col("id"))).alias("id"), F.count("*").alias("spans"))
