"""Session defaults and the shared folder used for durable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "sparkprep", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir, or where that is unset a folder in the warehouse, which the
    tables of a cluster share as well."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sparkprep-shared"
    sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and go on from the files.

    Used where several later jobs read an expensive result: the files outlive any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same in columns, for a table whose later jobs each read a few of them; types parquet has not are kept in rows."""
    if any(t in df.schema.simpleString() for t in ("void", "interval")):
        return durable(df)
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limit(spark: SparkSession, name: str, default: int) -> int:
    """A bound as the session sets it (``spark.conf.set("sparkprep.rowsPerRange", ...)``), else its default.

    sparkprep.exactRows: up to so many rows quantiles keep all distinct values in one buffer; beyond they are narrowed.
    sparkprep.rowsPerRange: rows of one range of a global order. sparkprep.broadcastRows, sparkprep.broadcastBytes: largest
    mapping that is broadcast. sparkprep.batchBytes: bytes of an Arrow batch that sparkprep.llm hands to Python. The results
    are the same for any value.
    """
    return int(spark.conf.get(f"sparkprep.{name}", None) or default)
