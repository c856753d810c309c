"""Incremental landing: each new recording is processed once.

File sources remember what they have read in the query's checkpoint, so a rerun
takes up only new files; the sink writes each micro-batch under its own number,
so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def land_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, state: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Process all new Parquet files of a folder with a batch transform, then stop; state is the checkpoint folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
