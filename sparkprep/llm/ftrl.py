"""Logistic regression trained by follow-the-regularised-leader with per-coordinate rates, in parallel shards.

A shard is a bounded group of sample rows, written once. In every epoch each shard continues from the same state (z, n),
walks its rows in a fixed order, and returns its state in chunks of coordinates; Spark averages the chunks over the
shards. The state has a fixed size (classes x dimensions), so what is sent does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import stored

CHUNK = 1 << 14


@dataclass(frozen=True)
class Rates:
    """alpha and beta shape the per-coordinate step, l1 and l2 are the elastic net."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


def weights(z: np.ndarray, n: np.ndarray, r: Rates) -> np.ndarray:
    """The weights a state stands for; coordinates with |z| within l1 are exactly zero."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - r.l1, 0.0)
    return -shrunk / ((r.beta + np.sqrt(n)) / r.alpha + r.l2)


def _probabilities(s: np.ndarray) -> np.ndarray:
    """Sigmoid of one score, or softmax of several."""
    if len(s) == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(s, -60, 60)))
    e = np.exp(s - s.max())
    return e / e.sum()


def walk(z: np.ndarray, n: np.ndarray, rows, r: Rates) -> None:
    """One pass over (indices, values or None, class) rows; z and n have a line per class and change in place."""
    classes = len(z)
    for idx, val, y in rows:
        zi, ni = z[:, idx], n[:, idx]
        w = weights(zi, ni, r)
        p = _probabilities(w.sum(1) if val is None else w @ val)
        p[y if classes > 1 else 0] -= 1.0 if classes > 1 else float(y)
        g = p[:, None] * (1.0 if val is None else val[None, :])
        g = np.broadcast_to(g, zi.shape)
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / r.alpha
        z[:, idx] = zi + g - step * w
        n[:, idx] = ni + g * g


def sharded(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """The rows in the shared folder, one file per shard, in the order of a hash of the key column.

    By a hash of their numbers several shards could land in one task and others stay empty, so each is dealt by a key that
    the hash sends to a task of its own.
    """
    spot = F.pmod(F.hash("id"), F.lit(shards))
    found = rows.sparkSession.range(0, 64 * shards, 1, 1).groupBy(spot.alias("at")).agg(F.min("id").alias("key")).orderBy("at").collect()
    keys = F.array(*[F.lit(r["key"]).cast("long") for r in found])
    keyed = rows.withColumn("order", F.xxhash64(key)).withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int"))
    return stored(keyed.repartition(shards, F.get(keys, F.col("shard"))).sortWithinPartitions("shard", "order"), "shards")


def fit(rows: DataFrame, classes: int, dims: int, r: Rates, epochs: int) -> np.ndarray:
    """Weights (lines of classes, or one for two classes) from sharded rows with the columns shard, y, idx, val.

    idx holds little-endian 32-bit coordinates, each at most once; val 32-bit floats, or null where all are 1.
    """
    lines = 1 if classes == 2 else classes
    spark = rows.sparkSession
    size = lines * dims
    state = (np.zeros(size, np.float32), np.zeros(size, np.float32))
    schema = "chunk int, z binary, n binary"
    names = pa.schema([("chunk", pa.int32()), ("z", pa.binary()), ("n", pa.binary())])
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast(state)

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a task reads one shard, or a few small ones
            for b in batches:
                for k, i, v, y in zip(*(b.column(c).to_pylist() for c in ("shard", "idx", "val", "y"))):
                    if k not in own:
                        own[k] = tuple(a.reshape(lines, dims).astype(float) for a in sent.value)
                    idx = np.frombuffer(i, "<u4").astype(np.int64)
                    walk(*own[k], [(idx, None if v is None else np.frombuffer(v, "<f4").astype(float), y)], r)
            for z, n in own.values():
                z, n = z.ravel().astype(np.float32), n.ravel().astype(np.float32)
                at = range(0, size, CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a // CHUNK for a in at], pa.int32()), *(pa.array([x[a : a + CHUNK].tobytes() for a in at], pa.binary()) for x in (z, n))],
                    schema=names,
                )

        def mean(t: pa.Table) -> pa.Table:
            z, n = (np.mean([np.frombuffer(b, np.float32) for b in t.column(c).to_pylist()], axis=0).astype(np.float32).tobytes() for c in ("z", "n"))
            return pa.table([t.column("chunk")[:1], pa.array([z], pa.binary()), pa.array([n], pa.binary())], schema=names)

        got = rows.select("shard", "y", "idx", "val").mapInArrow(shard, schema).groupBy("chunk").applyInArrow(mean, schema).collect()
        sent.unpersist()
        z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
        for row in got:
            a = row["chunk"] * CHUNK
            z[a : a + CHUNK], n[a : a + CHUNK] = np.frombuffer(row["z"], np.float32), np.frombuffer(row["n"], np.float32)
        state = (z, n)
    return weights(*(a.astype(float).reshape(lines, dims) for a in state), r)
