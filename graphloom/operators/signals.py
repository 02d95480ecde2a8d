"""Signals (stack traces, diffs, test ids) to the nodes that they speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import test_label
from graphloom.functions.text import basename
from graphloom.operators import lookup


def signal_kind(text: Column) -> Column:
    """Which kind of signal a text is: diff, stacktrace or test."""
    plain = F.trim(text)
    return (
        F.when(text.contains("+++ ") | text.contains("--- a/") | text.contains("\n@@ "), "diff")
        .when((text.contains('File "') & text.contains("line ")) | text.contains(".go:") | text.contains("\n  at "), "stacktrace")
        .when(plain.contains("::") & ~plain.rlike(r"\s"), "test")
        .otherwise("stacktrace")
    )


def path_frames(text: Column) -> Column:
    """Paths and 1-based lines of all frames of a text, in order: ``File "x", line n`` or else tokens ``path.ext:n``."""
    python = r'^\s*File "([^"]*)"[^\n]*?line ([0-9]+)'
    token = r"(?:^|[\s(),])([^\s(),:]*\.[^\s(),:]*[^\s(),:.]):([0-9]+)"
    pick = lambda line, p: F.arrays_zip(
        F.regexp_extract_all(line, F.lit(p), F.lit(1)).alias("path"), F.regexp_extract_all(line, F.lit(p), F.lit(2)).alias("line")
    )
    per_line = F.transform(F.split(text, "\r?\n"), lambda x: F.when(x.rlike(python), pick(x, python)).otherwise(pick(x, token)))
    return F.filter(F.flatten(per_line), lambda f: f.line.cast("int").isNotNull())


def diff_frames(diffs: DataFrame) -> DataFrame:
    """File and new line number (from 1) of every line that the unified diffs (id, text) add.

    A file of ``/dev/null`` has none. Lines are numbered by what the hunk's head says and how many lines of the new file
    precede them; the windows run inside one diff.
    """
    lines = diffs.select("id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    file = F.regexp_replace(F.trim(F.regexp_extract("line", r"^\+\+\+ ([^\t]*)", 1)), "^b/", "")
    head, hunk = F.col("line").startswith("+++ ") | F.col("line").startswith("--- "), F.col("line").startswith("@@ ")
    order = W.partitionBy("id").orderBy("at")
    marked = lines.select(
        "id", "at", "line", head.alias("head"), hunk.alias("hunk"),
        F.last(F.when(F.col("line").startswith("+++ "), file), True).over(order).alias("file"),
        F.last(F.when(hunk, F.struct("at", F.regexp_extract("line", r"\+([0-9]+)", 1).cast("int").alias("start"))), True).over(order).alias("h"),
    )
    counts = (~F.col("head") & ~F.col("hunk") & ~F.col("line").startswith("-") & (F.col("at") > F.col("h.at"))).cast("int")
    inside = W.partitionBy("id", "h.at").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    numbered = marked.withColumn("new", F.col("h.start") + F.coalesce(F.sum(counts).over(inside), F.lit(0)))
    added = numbered.where("line like '+%' and not head and file <> '/dev/null'")
    return added.select("id", "file", F.coalesce("new", F.lit(0)).cast("int").alias("line"))


def resolve_file(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes (id) in a file of the same base name as each path (path)."""
    named = nodes.where("file is not null").select("id", basename(F.col("file")).alias("base"))
    return files.select("path", basename(F.col("path")).alias("base")).distinct().join(named, "base").select("path", "id")


def resolve_test_ids(texts: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """The node of every test id in texts (id, text): by the end of its qualified name, else by a bare one, else by name.

    In each tier the primary node counts. Ends are matched by equality on as many last segments as the id has.
    """
    tokens = texts.select("id", F.explode(F.split("text", r"\s+")).alias("token")).where(F.col("token").contains("::"))
    wanted = tokens.select("id", "token", test_label(F.col("token")).alias("q")).where("q <> ''")
    wanted = wanted.withColumn("last", F.element_at(F.split("q", "::"), -1)).withColumn("n", F.size(F.split("q", "::")))
    sizes = [r.n for r in wanted.select("n").distinct().orderBy("n").collect()]  # as many as ids have segments
    parts = F.split("qname", "::")
    ends = F.array(*[F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "::")) for n in sizes]) if sizes else F.array().cast("array<string>")
    by_end = nodes.select(F.col("id").alias("node"), F.explode(F.array_compact(ends)).alias("q"), F.lit(0).alias("tier"))
    by_bare = nodes.select(F.col("id").alias("node"), F.col("qname").alias("last"), F.lit(1).alias("tier"))
    by_name = nodes.where("name is not null").select(F.col("id").alias("node"), F.col("name").alias("last"), F.lit(2).alias("tier"))
    keep = ["id", "token", "node", "tier"]
    hits = wanted.join(by_end, "q").select(keep).unionByName(wanted.join(by_bare.unionByName(by_name), "last").select(keep))
    ranked = hits.join(degree.withColumnRenamed("id", "node"), "node", "left")
    best = F.min_by("node", F.struct("tier", -F.coalesce("degree", F.lit(0)), F.col("node")))
    return ranked.groupBy("id", "token").agg(best.alias("node"))


def resolve_signals(signals: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that signals (id, text) speak of, by the kind that each signal is: added lines, frames or test ids.

    A frame means the narrowest node around its line, and the file's nodes without lines of their own if there is none.
    """
    from graphloom.operators.resolve import frame_nodes

    kinds = signals.where("text is not null").withColumn("kind", signal_kind(F.col("text")))
    diffs = diff_frames(kinds.where("kind = 'diff'")).select("id", F.col("file").alias("path"), F.col("line").cast("bigint").alias("line"))
    traces = kinds.where("kind = 'stacktrace'").select("id", F.explode(path_frames(F.col("text"))).alias("f"))
    frames = diffs.unionByName(traces.select("id", "f.path", F.col("f.line").cast("bigint").alias("line"))).distinct()
    keyed = frames.select("id", "path", "line", F.concat_ws("\x01", "id", "path", F.col("line").cast("string")).alias("frame"))
    hit = frame_nodes(keyed.select("frame", "path", "line"), nodes).select("frame", F.col("id").alias("node"))
    found = keyed.join(hit, "frame").select("id", "node")
    tests = resolve_test_ids(kinds.where("kind = 'test'").select("id", "text"), nodes, lookup.degrees(edges)).select("id", "node")
    return found.unionByName(tests).distinct()
