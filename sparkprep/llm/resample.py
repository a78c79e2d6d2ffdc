"""Importance resampling towards a target distribution.

Hashed n-gram counts of a corpus and of a target corpus give every bucket a gain; a document's weight is the mean gain of
its n-grams, and a draw without replacement takes the highest weights with Gumbel noise from a hash of the id.

N-grams are read off the text directly: letters A-Z are lowered, every run of separators becomes one space, and one
overlapped regular expression per length, held to word boundaries by lookarounds, gives the spans. A span's bytes are
its feature, since its words already stand one space apart.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F

from .shared import python_columns, stored

# lowers A-Z, keeps a-z, 0-9 and all bytes of other code points, and turns the rest into spaces
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RUN_OF_SPACES = regex.compile(rb" {2,}")


def scanners(n_max: int) -> list[regex.Pattern]:
    """One expression for each length up to n_max: so many words, each a space apart, between word boundaries."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, n_max + 1)]


def spaced(text: bytes | None) -> bytes:
    """The words of a text, one space apart. Null is like the empty text."""
    return RUN_OF_SPACES.sub(b" ", (text or b"").translate(SPACED)).strip(b" ")


def spans(words: bytes, patterns: list[regex.Pattern]) -> Iterator[bytes]:
    """Every run of one to so many words of a spaced text, repeats included."""
    for p in patterns:
        for m in p.finditer(words, overlapped=True):
            yield m[0]


def features(docs: DataFrame, text_col: str, keep: list[str], n_max: int, buckets: int) -> DataFrame:
    """The kept columns, n_words, n_features and features: the buckets of all n-grams as little-endian unsigned numbers."""

    def make():
        patterns, crc32, kind = scanners(n_max), zlib.crc32, _kind(buckets)

        def batch(b: pa.RecordBatch) -> dict:
            n_words, n_features, packed = [], [], []
            for text in b.column(text_col):
                words = spaced(text.as_py())
                found = np.array([crc32(s) % buckets for s in spans(words, patterns)], kind)
                n_words.append(words.count(b" ") + 1 if words else 0)
                n_features.append(len(found))
                packed.append(found.tobytes())
            return {"n_words": n_words, "n_features": n_features, "features": packed}

        return batch

    return python_columns(docs, make, keep, "n_words long, n_features long, features binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of features(): every task sums its own rows first, so it sends one row a bucket at most."""
    kind = _kind(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], names=["bucket", "n"])

    parts = found.select("features").mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * log ratio of the add-one estimates) of every bucket. As many numbers as buckets reach the driver."""
    counted = []
    for table in (source, target):
        n = [0] * buckets
        for r in bucket_counts(table, buckets).collect():
            n[r["bucket"]] = r["n"]
        counted.append(n)
    s, t = counted
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(seed: str, key: str | None) -> int:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id (null: an empty id)."""
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    n_max: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
    carry: list[str] | None = None,
) -> DataFrame:
    """(id, n_features, weight, score, rank[, row]) for every row of docs; row is a struct of the columns to carry.

    rank numbers the drawn rows from 1: of the rows with at least least_words words, so many percent (rounded down) with
    the highest scores, ties to the smaller id, a null id last, rows of one id and score in any order. Null and empty texts have
    no features, weight 0, and are never drawn unless least_words is 0. An empty target, like an empty corpus, counts
    nothing: its estimate is the same for every bucket. Rows that repeat are rows of their own; as they share the noise
    of their id they stand next to each other.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")]
    if carry is not None:
        columns.append(F.struct(*carry).alias("row"))
    keep = ["id"] + ["row"] * (carry is not None)
    found = stored(features(docs.select(*columns), "text", keep, n_max, buckets), "features")
    aim = features(target.select(F.col(target_text_col).cast("string").cast("binary").alias("text")), "text", [], n_max, buckets)
    gain, kind = SparkContext.getOrCreate().broadcast(gains(found, aim, buckets)), _kind(buckets)

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            weight, score = [], []
            for packed, key in zip(b.column("features"), b.column("key")):
                own = gain.value[np.frombuffer(packed.as_py(), kind)]
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
                score.append(weight[-1] + noise(seed, key.as_py()))
            return {"weight": weight, "score": score}

        return batch

    weighed = python_columns(found.withColumn("key", F.col("id").cast("string")), make, [*keep, "n_words", "n_features"], "weight long, score long")
    return _ranked(weighed, least_words, percent).select("id", "n_features", "weight", "score", "rank", *keep[1:]).withColumnRenamed("id", id_col)


def _ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds rank: the place in the order of the score among the drawn rows, null for all others.

    Rows are dealt by ranges of (score, id, a number of their own), so that a score or an id that many rows share is cut
    like any other; a row's place is its number within its range and the rows of the ranges before, one number a range.
    """
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("own")]
    able = rows.where(enough).withColumn("own", F.monotonically_increasing_id())
    sorted_ = able.repartitionByRange(*order).sortWithinPartitions(*order).drop("own")
    placed = stored(sorted_.withColumn("place", F.monotonically_increasing_id()), "ranked")
    # the number of a row: the partition's number above the lowest 33 bits, the row's number in it below
    piece, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["piece"], r["n"]) for r in placed.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    start = placed.sparkSession.createDataFrame(starts, "piece long, start long")
    drawn = placed.withColumn("piece", piece).join(F.broadcast(start), "piece")
    place = F.col("start") + within + 1
    drawn = drawn.withColumn("rank", F.when(place <= F.lit(before * percent // 100), place))
    columns = [c for c in placed.columns if c != "place"] + ["rank"]
    return drawn.select(*columns).union(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that scores() draws, all their columns."""
    got = scores(docs, target, carry=docs.columns, **options)
    return got.where("rank IS NOT NULL").select("row.*")
