"""Scans of source trees and documents: regions, bundles, languages, markdown sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import always_region, basename


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``source`` of every file below a folder, but for folders of version control and editors."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    return rows.where(~F.col("path").rlike(r"/(\.git|\.hg|\.svn|\.idea|\.vscode)/"))


def region_anchors(files: DataFrame) -> DataFrame:
    """One row per collapsed directory (repo, path): the topmost whose name says vendored or build output, with its files."""
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    marked = F.array_position(F.transform(parts, lambda x: always_region(x).isNotNull()), True).cast("int")
    top = files.where(marked > 0).select("repo", F.array_join(F.slice(parts, F.lit(1), marked), "/").alias("region"), F.element_at(parts, marked).alias("name"))
    return top.groupBy("repo", "region").agg(F.first(always_region(F.col("name"))).alias("provenance"), F.count("*").alias("files"))


def bundle_dirs(files: DataFrame, least: int = 3) -> DataFrame:
    """Directories of at least ``least`` files named like ``x.<8 or more hex digits>.js``."""
    hashed = basename(F.col("path")).rlike(r"\.[0-9a-f]{8,}\.(js|mjs|css|map)$")
    dirs = files.select("repo", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), hashed.alias("h"))
    return dirs.groupBy("repo", "dir").agg(F.count_if("h").alias("hashed")).where(F.col("hashed") >= least)


def markdown_sections(documents: DataFrame) -> DataFrame:
    """Sections of each document (doc_id, text) at ``#`` and ``##`` headings: heading, slug, lines, characters.

    What stands before the first heading is section 0, without a heading. Null and empty texts have no section.
    """
    # the text is cut before each heading, so no line leaves its document
    cut = F.split(F.col("text"), r"(?m)(?=^##? )")
    rows = documents.where("text <> ''").select("doc_id", F.posexplode(cut).alias("k", "body")).where("body <> ''")
    heading = F.regexp_extract("body", r"^##? ([^\n]*)", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("heading")), r"[^a-z0-9 -]", ""), " ", "-")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("k")) - 1
    return rows.withColumn("heading", heading).select(
        "doc_id",
        first.alias("section"),
        "heading",
        F.when(F.col("heading") == "", F.when(first == 0, "overview").otherwise(F.concat(F.lit("section-"), first))).otherwise(slug).alias("slug"),
        F.length("body").alias("chars"),
    )


def manifest_name(manifests: DataFrame) -> DataFrame:
    """A repository's name by its manifests (repo, path, source): Cargo, package.json, pyproject, composer, go.mod."""
    s = F.col("source")
    toml = r'(?m)^\s*name\s*=\s*"([^"]+)"'
    name = basename(F.col("path"))
    ranked = lambda k, v: F.struct(F.lit(k).alias("p"), v.alias("name"))
    found = (
        F.when(name == "Cargo.toml", ranked(1, F.regexp_extract(s, toml, 1)))
        .when(name == "package.json", ranked(2, F.get_json_object(s, "$.name")))
        .when(name == "pyproject.toml", ranked(3, F.regexp_extract(s, toml, 1)))
        .when(name == "composer.json", ranked(4, F.get_json_object(s, "$.name")))
        .when(name == "go.mod", ranked(5, F.regexp_extract(s, r"(?m)^module\s+(?:\S*/)?(\S+)", 1)))
    )
    rows = manifests.select("repo", found.alias("f")).where("f.name <> ''")
    return rows.groupBy("repo").agg(F.min_by("f.name", "f.p").alias("name"))
