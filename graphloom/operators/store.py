"""Maintenance of stored graphs: shards that are only written when they changed, cells that are replaced or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import materialise


def shard_hashes(rows: DataFrame, shard: list[str]) -> DataFrame:
    """Rows and an order-free content hash of every shard."""
    return rows.groupBy(*shard).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(rows.columns))).alias("hash"))


def changed_shards(rows: DataFrame, manifest: DataFrame, shard: list[str]) -> DataFrame:
    """Shards whose rows differ from those the manifest (shard, rows, hash) tells of, and shards that are gone."""
    new = shard_hashes(rows, shard)
    old = manifest.select(*shard, F.col("rows").alias("old_rows"), F.col("hash").alias("old_hash"))
    both = new.join(old, shard, "full_outer")
    status = F.when(F.col("rows").isNull(), "gone").when(F.col("old_rows").isNull(), "new")
    status = status.when((F.col("rows") != F.col("old_rows")) | (F.col("hash") != F.col("old_hash")), "changed").otherwise("same")
    return both.select(*shard, "rows", status.alias("status"))


def write_sharded(rows: DataFrame, path: str, shard: list[str]) -> DataFrame:
    """Write the shards that changed since the last time and the manifest; returns their status."""
    spark: SparkSession = rows.sparkSession
    manifest_path = f"{path}/_shards"
    try:
        manifest = materialise(spark.read.parquet(manifest_path), "manifest")
    except Exception as e:  # noqa: BLE001 - only a missing path means a first build
        if "PATH_NOT_FOUND" not in str(e):
            raise
        manifest = shard_hashes(rows, shard).where("false")
    status = materialise(changed_shards(rows, manifest, shard), "status")
    dirty = rows.join(status.where("status in ('new', 'changed')"), shard, "left_semi")
    # one file set per shard: rows of a shard meet before they are written
    dirty.repartition(*shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*shard).parquet(f"{path}/data")
    shard_hashes(rows, shard).write.mode("overwrite").parquet(manifest_path)
    return status


def read_sharded(spark: SparkSession, path: str, shard: list[str]) -> DataFrame:
    """The shards that the manifest names; those that are gone stay out."""
    return spark.read.parquet(f"{path}/data").join(spark.read.parquet(f"{path}/_shards").select(*shard), shard, "left_semi")


def upsert_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells (node_id, ord, cell_type, text) with the first cell of each change's node and type replaced, or the change added.

    Of several changes for one node and type the last by text counts. A change for a node without cells starts with ord 0.
    """
    new = changes.groupBy("node_id", "cell_type").agg(F.max("text").alias("new_text"))
    first = cells.groupBy("node_id", "cell_type").agg(F.min("ord").alias("first_ord"))
    touched = first.join(new, ["node_id", "cell_type"])
    kept = cells.join(touched, ["node_id", "cell_type"], "left").select(
        "node_id", "ord", "cell_type", F.when(F.col("ord") == F.col("first_ord"), F.col("new_text")).otherwise(F.col("text")).alias("text")
    )
    last = cells.groupBy("node_id").agg(F.max("ord").alias("last_ord"))
    fresh = new.join(first, ["node_id", "cell_type"], "left_anti").join(last, "node_id", "left")
    place = F.coalesce(F.col("last_ord") + 1, F.lit(0)) + F.row_number().over(_by_type()) - 1
    return kept.unionByName(fresh.select("node_id", place.cast("int").alias("ord"), "cell_type", F.col("new_text").alias("text")))


def _by_type():
    from pyspark.sql import Window as W

    return W.partitionBy("node_id").orderBy("cell_type")


def remove_cells(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """Cells without those of the nodes and types (node_id, cell_type) in ``gone``."""
    return cells.join(gone.select("node_id", "cell_type").distinct(), ["node_id", "cell_type"], "left_anti")


def reuse_parses(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse again and cached rows that still hold, by path, content and language."""
    key = ["repo", "path", "lang", "hash"]
    now = files.withColumn("hash", F.xxhash64("source"))
    return now.join(cache.select(*key).distinct(), key, "left_anti"), cache.join(now.select(*key).distinct(), key, "left_semi")


def export_nodes(nodes: DataFrame, cells: DataFrame, options: DataFrame) -> DataFrame:
    """Nodes for export: one for each qualified name of a repository, without noise and excluded names.

    Noise (vendored, generated, build output or synthetic by the ORIGIN cell) stays where a repository includes it; a null
    option does not. The row of the lowest id counts of equal names.
    """
    from graphloom.functions.text import glob_match

    origin = cells.where("cell_type = 15").groupBy(F.col("node_id").alias("id")).agg(F.min(F.get_json_object("text", "$.provenance")).alias("provenance"))
    o = options.groupBy("repo_id").agg(F.max("include_noise").alias("include_noise"), F.max("exclude_globs").alias("globs"))
    rows = nodes.join(origin, "id", "left").join(o, "repo_id", "left")
    noise = F.lower(F.coalesce("provenance", F.lit(""))).isin("vendored", "generated", "build_output", "dependency", "synthetic")
    barred = F.exists(F.coalesce("globs", F.array().cast("array<string>")), lambda x: glob_match(x, F.col("qname")))
    kept = rows.where((~noise | F.coalesce("include_noise", F.lit(False))) & ~barred)
    return kept.groupBy("repo_id", "qname").agg(F.min("id").alias("id"))
