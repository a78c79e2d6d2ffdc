"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length (where lengths differ, one more component makes up for it, so that the largest inner
product is still the nearest direction). A fast pseudo-rotation, three rounds of random signs and a Hadamard transform,
turns each; the signed axis nearest to the result is its bucket in a table. A query probes the buckets of the axes it
lies nearest to, in each of several tables; what it finds is ranked by the exact inner product of the original vectors.
How many buckets to probe is measured on a bounded sample of queries against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import stored, unit_hash
from .vectors import best, matrix, merged, valid


class Rotations:
    """The tables' pseudo-rotations; longest is the largest vector length, level whether all lengths are about that."""

    def __init__(self, dim: int, tables: int, longest: float, level: bool, seed: int):
        self.longest, self.level = longest, level
        self.size = 1 << max(0, (dim + (not level)) - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def _turn(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x, h = x * s, 1
            while h < self.size:
                x = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), -1)
                h *= 2
            x /= np.sqrt(self.size)
        return x

    def axes(self, v: np.ndarray, query: bool) -> list[np.ndarray]:
        """For each table the inner products with all signed axes, + before -."""
        x = np.zeros((len(v), self.size))
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        x[:, : v.shape[1]] = v / norm if query or self.level else v / self.longest
        if not query and not self.level:
            x[:, v.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (norm[:, 0] / self.longest) ** 2))
        return [np.concatenate([y, -y], 1) for y in (self._turn(x, s) for s in self.signs)]

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """The bucket in each table, one line per vector."""
        return np.stack([a.argmax(1) for a in self.axes(v, False)], 1)

    def order(self, v: np.ndarray) -> np.ndarray:
        """(vector, table, axis): all buckets from the nearest axis to the farthest."""
        return np.stack([np.argsort(-a, 1, kind="stable") for a in self.axes(v, True)], 1)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with vectors, each summed by itself, so that equal vectors get equal scores."""
    return (v * q).sum(1)


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: int, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best; rough scores from a matrix product only leave out what is clearly worse."""
    at = np.flatnonzero(ids != own)
    if len(at) > 4 * k:
        edge = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= edge - 1e-9 * max(1.0, abs(edge))]
    s = scores(q, v[at])
    top = best(s, ids[at], k)
    return at[top], s[top]


def fit(rows: DataFrame, asked: DataFrame, k: int, tables: int, sample: int, recall: float, seed: int) -> tuple[Rotations, int]:
    """The rotations, and how many buckets of each table a query must probe.

    For about `sample` queries, chosen by a hash, the k true neighbours are found among all rows; the number of probes is
    the smallest with which they would be found at the given share.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    got = rows.agg(F.max(norm).alias("high"), F.min(norm).alias("low"), F.max(F.size("v")).alias("dim")).first()
    if got["dim"] is None:
        return Rotations(1, tables, 1.0, True, seed), 1
    turn = Rotations(got["dim"], tables, got["high"], got["low"] >= 0.999 * got["high"], seed)
    n = asked.count()
    few = asked.where(unit_hash(F.col("vec_id"), seed) < min(1.0, sample / max(1, n))).limit(4 * sample).collect()
    if not few:
        return turn, 2 * turn.size
    ids, q = np.array([r["vec_id"] for r in few]), np.array([r["v"] for r in few])
    order = turn.order(q)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[2])[None, None, :], 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for b in batches:
            own, v = b.column("vec_id").to_numpy(), matrix(b)
            code, rough = turn.buckets(v), q @ v.T
            for i in range(len(ids)):
                at, s = nearest(q[i], v, own, ids[i], k, rough[i])
                first = place[i][np.arange(tables)[None, :], code[at]].min(1)
                top[i] = sorted([*top[i], *zip((-s).tolist(), own[at].tolist(), first.tolist())])[:k]
        out = [(int(i), TaskContext.get().partitionId(), vec, -s, probe) for i, held in zip(ids, top) for s, vec, probe in held]
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "task", "vec_id", "score", "probe"])

    # one list a query and task, merged in two steps, so that no group holds the lists of all tasks
    true = rows.mapInArrow(run, "query_id long, task long, vec_id long, score double, probe long")
    item = F.struct((-F.col("score")).alias("s"), "vec_id", "probe")
    lists = lambda made: F.slice(F.array_sort(made), 1, k).alias("top")
    true = true.groupBy("query_id", (F.col("task") % 64).alias("part")).agg(lists(F.collect_list(item)))
    true = true.groupBy("query_id").agg(lists(F.flatten(F.collect_list("top")))).select(F.explode("top").alias("t")).select("t.probe").collect()
    need = np.sort([r["probe"] for r in true]) if true else np.array([2 * turn.size - 1])
    return turn, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def search(
    vectors: DataFrame,
    queries: Callable[[DataFrame], DataFrame],
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 4,
    sample: int = 100,
    recall: float = 0.95,
    chunk_rows: int = 4096,
    first_rows: int = 1024,
    seed: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every query; every row is in the index.

    queries picks the query rows from the valid rows (vec_id, v). A bucket with more than chunk_rows vectors is split by a
    hash into chunks, and its queries go to each chunk, so that a crowded bucket is many tasks and nothing is left out. A
    query's own id is no candidate; repeated ids as in the exact search. Of about first_rows rows (a bounded sample) those in
    the probed buckets are compared with the query at the start: their k-th best score is what others must reach to leave
    their task. What is found is the same with any sample, or none. Empty tables give an empty result.
    """
    rows = stored(valid(vectors, id_col, vector_col, zero=False), "vectors")
    asked = stored(queries(rows).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    turn, probes = fit(rows, asked, k, tables, sample, recall, seed)
    asked = stored(asked.mapInArrow(_floors(rows, turn, probes, k, first_rows, seed), "vec_id long, v array<double>, floor double"), "queries")

    def placed(batches):
        for b in batches:
            code = turn.buckets(matrix(b)) + np.arange(tables) * 2 * turn.size
            yield _spread(b.append_column("floor", pa.array(np.zeros(len(b)))), code)

    def probing(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                code = turn.order(matrix(part))[:, :, :probes] + np.arange(tables)[None, :, None] * 2 * turn.size
                yield _spread(part, code.reshape(len(part), -1))

    schema = "vec_id long, v array<double>, floor double, bucket int"
    index = rows.mapInArrow(placed, schema)
    sizes = stored(index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")), "sizes")
    index = index.join(F.broadcast(sizes), "bucket")  # at most tables x 2 x dimensions rows
    index = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("role", F.lit(0))
    ask = asked.mapInArrow(probing, schema).join(F.broadcast(sizes), "bucket")
    ask = ask.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(1))
    cols = ["bucket", "chunk", "role", "vec_id", "v", "floor"]
    both = index.select(cols).unionByName(ask.select(cols)).repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "role")
    names = pa.schema([("query_id", pa.int64()), ("tile", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        here, ids, v, task = None, [], [], TaskContext.get().partitionId()
        top: dict[int, list] = {}

        def flush():
            out = [(query, i, -s) for query, held in top.items() for s, i in held]
            top.clear()
            query, i, s = zip(*out) if out else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array([task] * len(query), pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], schema=names
            )

        for b in batches:
            bucket, chunk, role, own, floor = (b.column(c).to_numpy() for c in ("bucket", "chunk", "role", "vec_id", "floor"))
            x = matrix(b)
            edges = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(chunk) != 0) | (np.diff(role) != 0)]) if len(b) else []
            for start, end in zip(edges, [*edges[1:], len(b)]):
                key = (bucket[start], chunk[start])
                if key != here:
                    here, ids, v = key, [], []
                if role[start] == 0:
                    ids.append(own[start:end])
                    v.append(x[start:end])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, v = [np.concatenate(ids)], [np.concatenate(v)]
                for part in range(start, end, 512):
                    q, qid = x[part : min(end, part + 512)], own[part : min(end, part + 512)]
                    for i, rough in enumerate(q @ v[0].T):
                        at, s = nearest(q[i], v[0], ids[0], qid[i], k, rough)
                        good = s >= floor[part + i]
                        found = zip((-s[good]).tolist(), ids[0][at[good]].tolist())
                        top[int(qid[i])] = sorted({*top.get(int(qid[i]), ()), *found})[:k]
                if len(top) > 50_000:
                    yield flush()
        yield flush()

    schema = "query_id long, tile long, vec_id long, score double"
    # a list of a query comes from one task; they are merged in a tree over the tasks
    return merged(both.mapInArrow(run, schema), k, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _floors(rows: DataFrame, turn: Rotations, probes: int, k: int, first_rows: int, seed: int):
    """A function over batches of queries that adds the k-th best score of the rows of a sample that the query's probes meet.

    The query's tables hold those k rows, so what scores less cannot be among the k nearest found and need not leave its task.
    """
    n = rows.count()
    some = rows.where(unit_hash(F.col("vec_id"), seed + 1) < min(1.0, first_rows / max(1, n))).limit(4 * first_rows).collect()
    ids, v = np.array([r["vec_id"] for r in some], np.int64), np.array([r["v"] for r in some], float)
    code = turn.buckets(v) if len(ids) else None

    def low(one: int, x: np.ndarray, order: np.ndarray) -> float:
        met = np.zeros(len(ids), bool)
        for t, near in enumerate(order):
            met |= np.isin(code[:, t], near)
        at, s = nearest(x, v[met], ids[met], one, k, v[met] @ x)
        distinct = len(np.unique(np.c_[ids[met][at], s], axis=0)) == k  # equal (id, score) pairs count once in a list
        return float(s[-1]) if distinct else -np.inf

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                q = matrix(part)
                order = turn.order(q)[:, :, :probes] if len(ids) else [None] * len(q)
                out += [low(*x) if len(ids) else -np.inf for x in zip(part.column("vec_id").to_pylist(), q, order)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(out, pa.float64())], names=["vec_id", "v", "floor"])

    return floors


def _spread(b: pa.RecordBatch, code: np.ndarray) -> pa.RecordBatch:
    """Each row once for each of its buckets."""
    at = pa.array(np.repeat(np.arange(len(b)), code.shape[1] if len(b) else 0))
    kept = [b.column(c).take(at) for c in ("vec_id", "v", "floor")]
    return pa.RecordBatch.from_arrays([*kept, pa.array(code.ravel().astype(np.int32))], names=["vec_id", "v", "floor", "bucket"])
