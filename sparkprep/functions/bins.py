"""Bin edges and bin numbers. One helper, two closures.

``right``: quantile bins, (a, b] with the lowest edge included. ``left``: histogram bins, [a, b) with the last
closed and values outside the edges left out (or clamped to the end bins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import quantiles
from .columns import num, ref
from .tree import choose


def merge_edges(edges: list[float | None]) -> list[float]:
    """Sorted edges without duplicates."""
    return sorted({e for e in edges if e is not None})


def edges(df: DataFrame, cols: list[str], n: int, mode: str = "exact", also: dict[str, Column] | None = None) -> tuple[dict[str, list[float]], dict]:
    """n-quantile edges per column, duplicates merged; and the values of further aggregates, from the same read."""
    got = quantiles.fit(df, cols, [i / n for i in range(n + 1)], mode, also={("also", k): e for k, e in (also or {}).items()})
    return {c: merge_edges(got[c]) for c in cols}, {k: got["also", k] for k in also or {}}


def index(x: Column, edge: list[float], closed: str = "right", outside: str = "drop") -> Column:
    """Bin number from 0, null for null values and for values outside the edges (unless clamped)."""
    if len(edge) < 2:
        return F.lit(None).cast("int")
    inner = [F.lit(e) for e in edge[1:-1]]
    number = choose([x > e if closed == "right" else x >= e for e in inner], [F.lit(i) for i in range(len(inner) + 1)])
    keep = x.isNotNull()
    if outside == "drop":
        keep = keep & (x >= F.lit(edge[0])) & (x <= F.lit(edge[-1]))
    return F.when(keep, number)


def melt(
    df: DataFrame,
    edge: dict[str, list[float]],
    keep: dict[str, Column],
    closed: str = "right",
    outside: str = "drop",
) -> DataFrame:
    """(kept columns, feature, bin): the bin numbers are computed in the scan, so only small keys travel."""
    numbers = F.array(*[index(num(c), e, closed, outside) for c, e in edge.items()])
    slim = df.select(*[e.alias(n) for n, e in keep.items()], F.posexplode(numbers).alias("_c", "bin")).filter(F.col("bin").isNotNull())
    return slim.select(*[ref(n) for n in keep], F.get(F.array(*[F.lit(c) for c in edge]), F.col("_c")).alias("feature"), "bin")
