"""The append-only flows of the batch operators, run as streams with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import score_by_rules


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files of a landing folder, a bounded number per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path)


def score_stream(rows: DataFrame) -> DataFrame:
    """Rule scores of a stream: stateless, so the batch expressions serve as they are."""
    return score_by_rules(rows)


def alert_counts(log: DataFrame, threshold: float = 0.75, late: str = "1 hour", window: str = "1 day", key: str | None = "id") -> DataFrame:
    """Entries at or above the threshold per user and day.  State is one counter per open (day, user); the
    watermark closes days, and rows later than it are dropped.  Time advances with every entry, alert or not.

    An entry that comes again is counted once: its id is kept until the watermark has passed it, and later it is too late.
    A log without the column `key` is counted as it is.
    """
    stamped = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    if key is not None and key in log.columns:
        stamped = stamped.dropDuplicatesWithinWatermark([key])
    hits = stamped.filter(F.col("churn_probability") >= F.lit(threshold))
    counted = hits.groupBy(F.window("created_at", window), "user_id").agg(F.count("*").alias("alerts"))
    return counted.select(F.col("window.start").alias("day"), "user_id", "alerts")


def alert_counts_batch(log: DataFrame, threshold: float = 0.75, window: str = "1 day") -> DataFrame:
    stamped = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    hits = stamped.filter(F.col("churn_probability") >= F.lit(threshold))
    return hits.groupBy(F.window("created_at", window), "user_id").agg(F.count("*").alias("alerts")).select(
        F.col("window.start").alias("day"), "user_id", "alerts"
    )


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """All files present now, then stop.  The file sink commits each batch once, also after a restart."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.format("parquet").start(path)


def upsert_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of open windows too: every micro-batch writes its changed rows under its own batch number, so a
    repeated batch overwrites itself; readers take the newest number per key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("day", "user_id").agg(F.max_by("alerts", "batch").alias("alerts"))
