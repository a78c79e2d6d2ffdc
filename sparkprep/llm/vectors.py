"""What the two vector searches share: valid rows, arrays from Arrow, top lists and their tree merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def valid(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    Left out: null ids, vectors that are null, empty or hold a null, NaN or infinite component, and without zero those of
    length 0. Vectors of another number of components than the commonest (of equally common ones the larger) have no
    inner product with the rest and are left out too.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)).where(fine)
    if not zero:
        out = out.where(F.exists(v, lambda x: x != 0))
    dims = out.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return out.where(F.size("v") == F.lit(dims[0]["dim"] if dims else 0))


def matrix(b: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The vectors of a batch as lines of a matrix."""
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, 0))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, largest first, ties to the smaller id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def merged(parts: DataFrame, k: int, tiles: int, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) from partial lists (query_id, tile, vec_id, score), merged in a tree of tiles.

    A group of a level holds at most fan_in lists of k rows. A vector that several lists of a query name counts once.
    """
    pair = F.struct((-F.col("score")).alias("s"), "vec_id")
    rows = parts.groupBy("query_id", "tile").agg(F.slice(F.array_sort(F.collect_set(pair)), 1, k).alias("top"))
    while tiles > 1:
        rows = rows.groupBy("query_id", F.floor(F.col("tile") / fan_in).alias("tile")).agg(F.flatten(F.collect_list("top")).alias("top"))
        rows = rows.withColumn("top", F.slice(F.array_sort(F.array_distinct("top")), 1, k))
        tiles = -(-tiles // fan_in)
    return rows.select("query_id", F.posexplode("top").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.s")).alias("score")
    )
