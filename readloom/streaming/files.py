"""File streams through the stateless record operators, and running counts over them.

Every per-record operator (parsing, predicates, mapping filters, read edits) is a projection or filter, hence valid on a
streaming DataFrame. Sinks are written exactly once per batch; restarting from the checkpoint continues where a lost
driver stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_text(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def run_available(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Everything that has arrived, through ``transform``, as Parquet; a later call takes only what came since."""
    q = transform(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(source: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the newest are left out once their window is closed."""
    return source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_totals(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Totals over everything that has arrived so far; ``out`` holds the newest state, and each call adds what came since."""
    q = transform(source).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
