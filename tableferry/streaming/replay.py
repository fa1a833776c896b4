"""Incremental load: replay a folder of files through the same mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableferry.session import fresh_path


def replay(
    spark: SparkSession,
    path: str,
    schema: StructType,
    mapping: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str | None = None,
    files_per_batch: int = 8,
    glob: str | None = None,
) -> list[dict]:
    """Load everything new under ``path`` and return the progress of its last batches.

    Spark keeps the progress of the most recent batches only; ``batch_counts``
    gives the rows of every batch ever loaded.

    Each micro-batch runs the mapping once and writes it once, under its own
    ``batch_id`` folder that a retry overwrites, so a batch that is run again
    after a failure leaves no duplicates.  The checkpoint remembers which files
    are done; a later call with the same checkpoint only loads new ones.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = mapping(reader.parquet(path))

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "replay-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [
        {"batch_no": p["batchId"], "row_count": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]}
        for p in query.recentProgress
        if p["numInputRows"]
    ]


def replayed(spark: SparkSession, target: str) -> DataFrame:
    """What a replay has loaded, with the batch each row came in."""
    return spark.read.parquet(target).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def batch_counts(loaded: DataFrame) -> DataFrame:
    """Rows loaded per batch."""
    return loaded.groupBy(F.col("batch_id").alias("batch_no")).agg(F.count(F.lit(1)).alias("row_count"))
