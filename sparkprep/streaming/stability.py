"""Stability of features per event-time window against a frozen baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bins
from ..functions.agg import count_if
from ..functions.columns import ref


@dataclass
class Baseline:
    """Decile edges of the development rows per feature, and their count per bin."""

    edges: dict[str, list[float]]
    counts: dict[tuple[str, int], int]


def baseline(df: DataFrame, cols: list[str], n: int = 10) -> Baseline:
    edge = {c: e for c, e in bins.edges(df, cols, n)[0].items() if len(e) > 1}
    found = bins.melt(df, edge, {}, closed="left").groupBy("feature", "bin").count().collect()  # n rows per feature
    return Baseline(edge, {(r["feature"], r["bin"]): r["count"] for r in found})


def csi_windows(df: DataFrame, base: Baseline, ts: str, window: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, feature, csi): the index of every window against the baseline, on a table or a stream.

    One row of state per window and feature holds the counts of its bins, so the index is an expression over that row and
    needs no further grouping. On a stream give ``late``, the time a window waits for its rows; its event time must be a
    point in time, so zoneless timestamps are read in the session time zone.
    """
    kind = df.schema[ts].dataType
    if late is not None:
        df = df.withColumn(ts, ref(ts).cast("timestamp")).withWatermark(ts, late)
    width = max((len(e) - 1 for e in base.edges.values()), default=0)
    if not width:
        return df.sparkSession.createDataFrame([], "window_start timestamp, feature string, csi double")
    cells = bins.melt(df, base.edges, {ts: ref(ts)}, closed="left")
    seen = F.array(*[count_if(F.col("bin") == i) for i in range(width)])
    found = cells.groupBy(F.window(ref(ts), window).alias("_w"), "feature").agg(seen.alias("_seen"))
    known = [x for f in base.edges for x in (F.lit(f), F.array(*[F.lit(base.counts.get((f, i), 0)).cast("bigint") for i in range(width)]))]
    found = found.withColumn("_dev", F.create_map(*known)[F.col("feature")])
    return found.select(F.col("_w.start").cast(kind).alias("window_start"), "feature", _index(F.col("_dev"), F.col("_seen")).alias("csi"))


def _index(dev: Column, seen: Column) -> Column:
    """Sum of the contributions of all bins: of the bins that both sides have, the difference of shares times the log of their ratio."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("double")
    share = lambda x: F.transform(x, lambda v: F.try_divide(v.cast("double"), total(x)))
    one = lambda a, b: F.when((a > 0) & (b > 0), (b - a) * F.ln(F.try_divide(b, a))).otherwise(F.lit(0.0))
    return F.aggregate(F.zip_with(share(dev), share(seen), one), F.lit(0.0), lambda a, v: a + v)


def csi_stream(
    stream: DataFrame, base: Baseline, ts: str, path: str, checkpoint: str, window: str = "1 day", late: str = "2 days"
) -> StreamingQuery:
    """Write the index of a window whenever its rows change it; rows later than ``late`` are dropped.

    Every window and feature has a folder of its own with the latest index, which a change replaces: what is stored grows
    with the windows, not with the batches, and a batch that is repeated after a failure replaces its own rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        out = batch.repartition("window_start", "feature").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("window_start", "feature").parquet(path)

    return (
        csi_windows(stream, base, ts, window, late)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )


def latest(spark: SparkSession, path: str, kind: str = "timestamp") -> DataFrame:
    """(window_start, feature, csi) as the stream left it."""
    return spark.read.schema(f"csi double, window_start {kind}, feature string").parquet(path).select("window_start", "feature", "csi")
