"""Helpers of the operators in this package: durable tables, folds, word hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import checkpoint_dir, limit

ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
WORD = re.compile(r"\w+")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the cluster."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written once as parquet to the shared folder and read back: later jobs start from the files."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo parts; a null counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def unit_hash(*parts) -> Column:
    """A number in [0, 1) from a hash of the columns or literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class HashCache(dict):
    """Word to 64-bit hash; forgets everything at a fixed number of entries, so its memory is bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def word_hashes(text: str | None, cache: HashCache) -> np.ndarray:
    """The hashes of the lower-cased words of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = WORD.findall(text.lower())
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A multiply-and-shift mix of 64-bit numbers, so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, learn: Column, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """(id, y) of about per_class ids of each label, chosen by a hash of the id, and the count of each label.

    Ids without label, with labels outside 0 and 1, or with both labels are left out. per_class is the bound of the
    sample and a parameter of every classifier here; the counts cover all labelled ids of the learning part.
    """
    y = F.col(label_col).cast("int")
    own = (
        labels.where(y.isin(0, 1) & F.col(id_col).isNotNull() & learn)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(y).alias("y"), F.max(y).alias("top"))
        .where("y = top")
        .drop("top")
    )
    own = stored(own, "labels")
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("y") == k, F.lit(min(1.0, per_class / n))).otherwise(rate)
    return own.where(unit_hash(F.col("id"), seed) < rate), counts


def small_batches(spark: SparkSession) -> None:
    """Arrow batches between Spark and Python hold sparkprep.batchBytes bytes (4 MB) at most, but for a single row.

    A task holds several copies of a batch on either side. Spark's own bounds, 10,000 rows and 64 MB, are far beyond what
    whole texts need, and what a worker has once taken it keeps for the tasks after.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit(spark, "batchBytes", 4 << 20))


def python_columns(df: DataFrame, make: Callable[[], Callable], keep: list[str], added: str) -> DataFrame:
    """The kept columns, untouched, and new ones computed batch by batch in Python.

    make() runs once per partition and returns a function of a record batch giving {new column: values}, or
    (row numbers, {new column: values}) where rows are repeated or left out. added lists the new columns, "a int, b long".
    """
    new = [tuple(x.split()) for x in added.split(",") if x]
    schema = T.StructType([df.schema[c] for c in keep] + (list(T.StructType.fromDDL(added).fields) if new else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            out = fn(b)
            at, out = out if isinstance(out, tuple) else (None, out)
            old = [b.column(c) for c in keep]
            if at is not None:
                at = pa.array(at, pa.int64())
                old = [c.take(at) for c in old]
            yield pa.RecordBatch.from_arrays(old + [pa.array(out[n], ARROW[t]) for n, t in new], names=schema.names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
