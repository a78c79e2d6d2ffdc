"""Running totals, row numbers and forward fill over a global order without a single-task window.

Rows are dealt into key ranges of about ``ROWS_PER_RANGE`` rows, one partition each, and written once with the number of
their range. Every range is ordered on its own, and what a range needs from the ranges before it comes from a tree: ranges
are summed up within blocks of ``FAN``, the blocks within blocks of blocks, and so on, so no task sees more than ``FAN``
of them however many there are. The ranges come from Spark's own bounded sample, and a key that fills a third of the
table costs one boundary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable, limit
from .columns import ref

ROWS_PER_RANGE = 2_000_000  # default of sparkprep.rowsPerRange
FAN = 1_000


def ranged(df: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, int] | None:
    """The n rows with the number ``_range`` of their key range, written to the shared folder, and how many ranges there
    are; None when all rows fit one range. Smaller numbers hold smaller keys, nulls first."""
    parts = math.ceil(n / limit(df.sparkSession, "rowsPerRange", ROWS_PER_RANGE))
    if parts <= 1:
        return None
    dealt = df.repartitionByRange(parts, *[ref(k) for k in keys])
    return durable(dealt.withColumn("_range", F.spark_partition_id().cast("long"))), parts


def _earlier(found: DataFrame, names: list[str], count: int, last: bool = False) -> DataFrame:
    """(_range, names): the sum of each name over the earlier ranges, or the last value there that is not null."""
    over = (lambda n: F.last(n, True)) if last else F.sum
    rows = (Window.unboundedPreceding, -1)
    if count <= FAN:
        w = Window.orderBy("_range").rowsBetween(*rows)
        return found.select("_range", *[over(n).over(w).alias(n) for n in names])
    blocks = found.withColumn("_block", F.floor(F.col("_range") / FAN))
    fold = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_range"))) if last else F.sum(n) for n in names]
    summed = blocks.groupBy("_block").agg(*[e.alias(n) for e, n in zip(fold, names)])
    above = _earlier(summed.withColumnRenamed("_block", "_range"), names, math.ceil(count / FAN), last)
    above = above.select(F.col("_range").alias("_block"), *[F.col(n).alias(f"_up_{n}") for n in names])
    w = Window.partitionBy("_block").orderBy("_range").rowsBetween(*rows)
    within = blocks.select("_block", "_range", *[over(n).over(w).alias(n) for n in names])
    both = (lambda n: F.coalesce(n, f"_up_{n}")) if last else (lambda n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_up_{n}", F.lit(0)))
    return within.join(above, "_block").select("_range", *[both(n).alias(n) for n in names])


def running(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    by: list[str] | None = None,
    at_most: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds inclusive running sums over the order of ``keys``, restarted for every value of ``by``.

    ``by`` names few groups (columns, classes); together with ``keys`` it must identify a row. The frame is a
    grouped result: unless it is known to have ``at_most`` the rows of one range, or is ``stored`` already, it
    is written once, since edges, totals and sums all read it.
    """
    by = by or []
    order = by + keys
    n = at_most
    if n is None or n > limit(df.sparkSession, "rowsPerRange", ROWS_PER_RANGE):
        df = df if stored else durable(df)
        n = df.count()
    plain = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    dealt = ranged(plain, order, n)
    if dealt is None:
        w = Window.partitionBy(*[ref(b) for b in by]) if by else Window.partitionBy(F.lit(0))
        w = w.orderBy(*[ref(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
        return plain.select(*df.columns, *[F.sum(f"_v_{n}").over(w).alias(n) for n in sums])
    cut, count = dealt
    totals = cut.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_o_{n}") for n in sums])
    offsets = _earlier(totals, [f"_o_{n}" for n in sums], count)
    w = Window.partitionBy("_range").orderBy(*[ref(k) for k in order]).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.select("_range", *df.columns, *[F.sum(f"_v_{n}").over(w).alias(f"_w_{n}") for n in sums])
    # the windows leave the rows dealt and sorted by range, so only the offsets travel to this join
    out = within.join(offsets, "_range").select(
        *df.columns, *[(F.col(f"_w_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums]
    )
    if not by:
        return out
    bases = plain.groupBy(*[ref(b) for b in by]).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    prior = Window.orderBy(*[ref(b) for b in by]).rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(
        *[ref(b).alias(f"_by_{b}") for b in by], *[F.sum(f"_t_{n}").over(prior).alias(f"_b_{n}") for n in sums]
    )
    same = [ref(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return out.join(F.broadcast(bases), same).select(
        *df.columns, *[(F.col(n) - F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums]
    )


def rank(df: DataFrame, keys: list[str], name: str, by: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Adds the position from 0 in the order of ``keys`` (within ``by``)."""
    return running(df, keys, {"_n": F.lit(1).cast("long")}, by, stored=stored).select(
        *df.columns, (F.col("_n") - 1).alias(name)
    )


def fill_forward(df: DataFrame, cols: list[str], order_by: list[str], partition_by: list[str]) -> DataFrame:
    """Null -> last earlier non-null value of the same partition, in ``order_by`` (which must be unique there)."""
    order = partition_by + order_by
    dealt = ranged(df, order, df.count())
    reach = (Window.unboundedPreceding, 0)
    if dealt is None:
        w = Window.partitionBy(*[ref(p) for p in partition_by]) if partition_by else Window.partitionBy(F.lit(0))
        w = w.orderBy(*[ref(o) for o in order_by]).rowsBetween(*reach)
        return df.select(*[F.last(ref(c), True).over(w).alias(c) if c in cols else ref(c) for c in df.columns])
    cut, count = dealt
    group = F.struct(*[ref(p).alias(f"p{i}") for i, p in enumerate(partition_by)], F.lit(1).alias("one"))
    at = F.struct(*[ref(o) for o in order])
    names = [f"_e_{i}" for i in range(len(cols))]
    ends = cut.groupBy("_range").agg(
        *[F.max_by(F.struct(group.alias("g"), ref(c).alias("v")), F.when(ref(c).isNotNull(), at)).alias(n) for n, c in zip(names, cols)]
    )
    carry = _earlier(ends, names, count, last=True)
    w = Window.partitionBy("_range", *[ref(p) for p in partition_by])
    w = w.orderBy(*[ref(o) for o in order_by]).rowsBetween(*reach)
    within = cut.select("*", *[F.last(ref(c), True).over(w).alias(f"_w_{i}") for i, c in enumerate(cols)])
    new = {}
    for i, c in enumerate(cols):
        earlier = F.when(F.col(f"_e_{i}.g").eqNullSafe(group), F.col(f"_e_{i}.v"))
        new[c] = F.coalesce(F.col(f"_w_{i}"), earlier)
    return within.join(carry, "_range").select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])
