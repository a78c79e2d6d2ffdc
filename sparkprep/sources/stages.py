"""Named stages of a run: the table as read, cleaned, processed and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAGES = ("raw", "cleaned", "processed", "predictions")


def _path(root: str, run: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {STAGES}")
    return f"{root.rstrip('/')}/{run}/{stage}"


def save(df: DataFrame, root: str, run: str, stage: str) -> DataFrame:
    """Write the stage and return it as read back, so later work starts from the files."""
    path = _path(root, run, stage)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, root: str, run: str, stage: str) -> DataFrame:
    return spark.read.parquet(_path(root, run, stage))
