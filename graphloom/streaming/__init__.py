"""Structured Streaming over the engine's tables: windows over events, and an incremental build of bronze files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum per window and type; rows later than ``late`` behind the newest are out in a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    per = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round(F.col("value").cast("double"), 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no more than ``gap`` between two."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    per = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return per.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def build_bronze(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Follow a folder of file rows (repo, path, source, scanned_at) and keep the newest row of each file in ``target``.

    Every batch only rewrites the repositories that it touches.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def upsert(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        newest = F.max_by(F.struct(*batch.columns), F.struct("scanned_at", F.xxhash64("source"))).alias("row")
        new = batch.groupBy("repo", "path").agg(newest).select("row.*")
        repos = new.select("repo").distinct()
        try:
            old = session.read.parquet(target).join(repos, "repo", "left_semi").select(*batch.columns)
            new = old.unionByName(new).groupBy("repo", "path").agg(newest).select("row.*")
        except Exception as e:  # noqa: BLE001 - the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        from graphloom.session import materialise

        new = materialise(new, "bronze")
        new.repartition("repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(target)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
