"""One aggregate for all columns: the only way the operators read statistics of a table."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# Aggregate expressions per job. More would outgrow the generated code (8 KB per compiled method) and run interpreted;
# jobs of other columns read other columns, so splitting costs no extra input.
CHUNK = 24


def fit(df: DataFrame, exprs: dict[Any, Column]) -> dict[Any, Any]:
    """Values of many aggregates on the driver: one row per chunk, whatever the table size."""
    keys = list(exprs)
    out: dict[Any, Any] = {}
    for start in range(0, len(keys), CHUNK):
        part = keys[start : start + CHUNK]
        row = df.agg(*[exprs[k].alias(f"a{i}") for i, k in enumerate(part)]).first()
        out.update({k: row[i] for i, k in enumerate(part)})
    return out


def long(
    df: DataFrame, stats: dict[str, dict[str, Column]], key: str = "column", chunk: int = CHUNK
) -> DataFrame:
    """Lazy report with one row per label: all aggregates of a chunk in one pass, then turned to rows.

    Every label carries the same statistic names with the same types.
    """
    if not stats:
        raise ValueError("no columns to aggregate")
    labels = list(stats)
    width = max(1, len(next(iter(stats.values()))))
    step = max(1, chunk // width)
    parts = []
    for start in range(0, len(labels), step):
        some = labels[start : start + step]
        wide = df.agg(*[e.alias(f"{i}_{n}") for i, lab in enumerate(some) for n, e in stats[lab].items()])
        rows = [
            F.struct(F.lit(lab).alias(key), *[F.col(f"{i}_{n}").alias(n) for n in stats[lab]])
            for i, lab in enumerate(some)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def count_if(cond: Column) -> Column:
    """Number of true rows; 0 for an empty table."""
    return F.count(F.when(cond, F.lit(1)))


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; null when a side is constant.

    The built-in divides by the product of the deviations, which is an error in ANSI mode when one is zero.
    """
    share, together = F.regr_r2(a, b), F.covar_pop(a, b)
    flat = share.isNull() | ((together == 0) & (share == 1))
    return F.when(~flat, F.signum(together) * F.sqrt(share))
