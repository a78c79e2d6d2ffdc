"""Value -> result mappings: fitted once, joined to any table, batch or stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import ref
from ..session import durable, limit

BROADCAST_ROWS = 100_000  # a mapping is broadcast only when it is known to have at most this many rows
BROADCAST_BYTES = 8 << 20  # and this many bytes of values
HOT_SHARE = 1_000  # a value holding more than 1/HOT_SHARE of all rows is hot; there are fewer than that many
TRACKED = 16_384  # keys that the sketch of frequent keys keeps
SPREAD = 4_096


@dataclass
class Lookup:
    """Mapping of one column: frame (value, n, result columns), its size and whether it is local data."""

    frame: DataFrame
    rows: int
    small: bool
    total: int = 0  # rows of the table a large mapping was counted on

    @property
    def results(self) -> list[str]:
        return [c for c in self.frame.columns if c not in ("value", "n")]


def settle(counted: DataFrame) -> DataFrame:
    """Counted values evaluated once: files in the shared folder."""
    return durable(counted)


class Size(int):
    """Number of values of a mapping; ``bytes`` is what their texts take."""

    bytes = 0


def sizes(counted: DataFrame, cols: list[str]) -> dict[str, int]:
    """Number of values per column, with their bytes."""
    took = F.sum(F.octet_length(F.col("value").cast("string")))
    got = counted.groupBy("column").agg(F.count(F.lit(1)).alias("k"), took.alias("b")).collect()
    out: dict[str, int] = {c: Size(0) for c in cols}
    for r in got:
        if r["column"] in out:
            out[r["column"]] = Size(r["k"])
            out[r["column"]].bytes = r["b"] or 0
    return out


def freeze(mapping: DataFrame, sizes: dict[str, int], stored: bool = False) -> dict[str, Lookup]:
    """Split (column, value, n, results) into one lookup per column.

    Mappings with a counted size within the bound become local data and are broadcast later; the others are
    written once to the shared folder, so neither the training table nor lost executors are needed again
    (unless they are ``stored`` there already).
    """
    spark = mapping.sparkSession
    out = {}
    most, heaviest = limit(spark, "broadcastRows", BROADCAST_ROWS), limit(spark, "broadcastBytes", BROADCAST_BYTES)
    small = [c for c, n in sizes.items() if n <= most and getattr(n, "bytes", 0) <= heaviest]
    large = [c for c in sizes if c not in small]
    schema = T.StructType([f for f in mapping.schema.fields if f.name != "column"])
    while small:
        batch, room = [], most  # what is gathered at once stays within the same bound
        while small and (not batch or sizes[small[0]] <= room):
            room -= sizes[small[0]]
            batch.append(small.pop(0))
        rows = mapping.filter(F.col("column").isin(batch)).collect()
        for c in batch:
            mine = [tuple(r[f.name] for f in schema.fields) for r in rows if r["column"] == c]
            out[c] = Lookup(spark.createDataFrame(mine, schema), sizes[c], True)
    if large:
        kept = mapping.filter(F.col("column").isin(large))
        kept = kept if stored else durable(kept)
        totals = {r["column"]: r["t"] for r in kept.groupBy("column").agg(F.sum("n").alias("t")).collect()}
        for c in large:
            mine = kept.filter(F.col("column") == F.lit(c)).drop("column")
            out[c] = Lookup(mine, sizes[c], False, totals.get(c) or 0)
    return out


def join(df: DataFrame, key: Column, lookup: Lookup, prefix: str) -> DataFrame:
    """Left join adding the result columns as ``prefix + name``; unknown keys give null."""
    results = [ref(r).alias(prefix + r) for r in lookup.results]
    if lookup.small:
        side = lookup.frame.select(F.col("value").alias(prefix + "key"), *results)
        return df.join(F.broadcast(side), key == F.col(prefix + "key"), "left").drop(prefix + "key")
    return _join_large(df, key, lookup, prefix)


def _hot(df: DataFrame, key: Column, lookup: Lookup) -> DataFrame:
    """(value, results) of the hot keys of the rows to be answered, whether the mapping knows them or not.

    A sketch of the most frequent keys (``approx_top_k``) sees the rows themselves: a value may be rare where the mapping was
    fitted and fill a third of a later batch. It tracks a fixed number of keys, and so finds every key above
    1/HOT_SHARE of the rows; its result is at most HOT_SHARE rows, so both joins here broadcast a bounded table. A stream
    cannot be read ahead: there the values that were hot in the fit count.
    """
    if df.isStreaming:
        return lookup.frame.filter(F.col("n") * F.lit(HOT_SHARE) > F.lit(lookup.total)).drop("n")
    rows = df.select(key.alias("k")).where("k IS NOT NULL")
    top = rows.agg(F.expr(f"approx_top_k(k, {HOT_SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("all"))
    keys = top.select("all", F.inline("top")).where(F.col("count") * F.lit(HOT_SHARE) > F.col("all")).select(F.col("item").alias("_hot"))
    known = lookup.frame.drop("n").join(F.broadcast(keys), F.col("value") == F.col("_hot")).drop("_hot")
    return keys.join(F.broadcast(known), F.col("_hot") == F.col("value"), "left").drop("value").withColumnRenamed("_hot", "value")


def _join_large(df: DataFrame, key: Column, lookup: Lookup, prefix: str) -> DataFrame:
    """Keys that are hot among the rows (a bounded number) are broadcast, the rest is shuffled on the key.

    Rows already answered by the hot side, and rows without a key, need no match on the cold side: there they carry
    a key of their own from a hash of the whole row, so they spread instead of piling up on one key.
    """
    k, hot_key, cold_key, spread = (prefix + s for s in ("key", "hot", "cold", "spread"))
    names = [prefix + r for r in lookup.results]
    hot = _hot(df, key, lookup).select(
        F.col("value").alias(hot_key), *[ref(r).alias(n + "_h") for r, n in zip(lookup.results, names)]
    )
    cold = lookup.frame.select(
        F.col("value").alias(cold_key), *[ref(r).alias(n + "_c") for r, n in zip(lookup.results, names)]
    )
    original = df.columns
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    out = df.withColumn(k, key).join(F.broadcast(hot), F.col(k) == F.col(hot_key), "left")
    done = F.col(hot_key).isNotNull() | F.col(k).isNull()
    own = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[ref(c) for c in hashable]), F.lit(SPREAD)).cast("string"))
    out = out.withColumn(spread, F.when(done, own).otherwise(F.col(k))).join(cold, F.col(spread) == F.col(cold_key), "left")
    picked = [F.when(F.col(hot_key).isNotNull(), ref(n + "_h")).when(F.col(k).isNotNull(), ref(n + "_c")).alias(n) for n in names]
    return out.select(*[ref(c) for c in original], *picked)
