"""A frozen plan on a stream: projections and stream-static joins, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.plan import Plan


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of the parquet files under a path: a folder, or one file.

    A file is accepted as the match of a pattern only, so the last character is made a class of one.
    """
    path = path.rstrip("/")
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_plan(stream: DataFrame, plan: Plan, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the prepared rows to parquet files. Rows are independent, so late ones need no care."""
    writer = plan.transform(stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
