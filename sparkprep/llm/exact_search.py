"""Exact top-k search: tiles of a matrix product of query blocks and shards, and a tree merge of the top lists.

Both sides are packed into blocks of rows, written once. A tile is a block of queries against a block of vectors: one
matrix product, of which each query keeps its k best. The lists of a query meet in a tree of tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import stored
from .vectors import best, matrix, merged, valid

SCALE = 1024.0


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles."""
    return np.floor(SCALE * v)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as 64-bit numbers.

    Exact in doubles while no sum can reach 2^53; else computed with Python's numbers and held within the 64-bit range.
    """
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q @ v.T).astype(np.int64)
    a = np.array([[int(x) for x in row] for row in q], object)
    b = np.array([[int(x) for x in row] for row in v], object)
    return np.clip(a @ b.T, -(2**63), 2**63 - 1).astype(np.int64)


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(block, n, dim, ids, data): up to size rows of (vec_id, v) as bytes.

    block is a number below the number of blocks, by a hash of the place in storage; two blocks may share one.
    """
    names = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def packed(batches):
        ids, vectors, n = [], [], 0

        def out():
            i, v = np.concatenate(ids), np.concatenate(vectors)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(i)], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([i.astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(v, "<f8").tobytes()])],
                schema=names,
            )

        for b in batches:
            for at in range(0, len(b), size):
                part = b.slice(at, size)
                if n + len(part) > size:
                    yield out()
                    ids, vectors, n = [], [], 0
                ids.append(part.column("vec_id").to_numpy())
                vectors.append(matrix(part))
                n += len(part)
        if n:
            yield out()

    made = stored(rows.mapInArrow(packed, "n int, dim int, ids binary, data binary"), name)
    return made.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, made.count()))))


def search(
    vectors: DataFrame,
    queries: Callable[[DataFrame], DataFrame],
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = 16_384,
    shard_rows: int = 16_384,
    fan_in: int = 16,
    share: int = 4,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest whole-number inner products of every query.

    queries picks the query rows from the valid rows (vec_id, v). A query's own id is no candidate. Of rows that share a
    query's id one vector is the query; as candidates repeated ids stay, but equal (id, score) pairs count once. With
    fewer candidates than k all are returned; empty tables give an empty result. Each block of queries is sent once for
    every `share` shards, so that the tiles of one block spread over many tasks.
    """
    rows = stored(valid(vectors, id_col, vector_col, zero=True), "vectors")
    asked = queries(rows).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = blocks(rows, shard_rows, "shards")
    ask = blocks(asked.coalesce(max(1, -(-asked.count() // query_rows))), query_rows, "queries")
    many, tiles = ask.count(), shards.count()
    # the grid of tiles: each shard meets each block of the stated queries, in the task of their common key: block and set of shards
    left = shards.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1))))).select(
        F.col("block").alias("tile"), F.col("query_block").cast("long").alias("query_block"), F.floor(F.col("block") / share).alias("shards"), "ids", "data", "dim"
    )
    copied = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, tiles - 1) // share).cast("long"))).alias("shards")
    right = ask.select(F.col("block").alias("query_block"), copied, F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    names = pa.schema([("query_id", pa.int64()), ("tile", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["query_ids"], "<i8")
                v = whole_numbers(np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"]))
                q = whole_numbers(np.frombuffer(r["query_data"], "<f8").reshape(-1, r["dim"]))
                for at in range(0, len(qids), 512):
                    found, own = [], qids[at : at + 512]
                    for one, score in zip(own, products(q[at : at + 512], v)):
                        others = np.flatnonzero(ids != one)
                        found.append(others[best(score[others], ids[others], k)])
                    pick = [np.repeat(own, [len(f) for f in found]), np.concatenate(found)]
                    line = np.repeat(np.arange(len(own)), [len(f) for f in found])
                    scores = np.concatenate([products(q[at + i : at + i + 1], v[f])[0] for i, f in enumerate(found)]) if len(line) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pick[0]), pa.array(np.full(len(line), r["tile"], np.int64)), pa.array(ids[pick[1]]), pa.array(scores)], schema=names)

    parts = left.join(right, ["query_block", "shards"]).mapInArrow(run, "query_id long, tile long, vec_id long, score long")
    return merged(parts, k, tiles, fan_in)
