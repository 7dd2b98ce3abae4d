"""The manifest log as a stream: the latest good record of each URL, kept up to date.

State is one record a URL. The same fold as the batch operator, so a finished stream equals it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.catalog import GOOD


def manifest_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 8) -> DataFrame:
    """New Parquet files of the log's folder, `files_a_trigger` in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def latest_by_url(log: DataFrame) -> DataFrame:
    good = log.filter(F.col("status").isin(*GOOD) & F.col("url").isNotNull() & F.col("stored_path").isNotNull())
    return good.groupBy("url").agg(F.max(F.struct("fetched_at", "event_id", "status", "stored_path")).alias("r")).select("url", "r.*")


def run_available(folded: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there and stops; the result is the in-memory table `name`, for tests and small logs."""
    query = folded.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_available(folded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's changed records to a folder of its own; the newest record of a URL is the current one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
