"""Value counts of many columns in one shuffle, per-column top-k and modes on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import FRACTIONAL, INTEGRAL, ref


def family(dtype: T.DataType) -> str:
    """Type under which the values of a column are counted: whole numbers stay exact beyond 2^53."""
    if isinstance(dtype, INTEGRAL):
        return "bigint"
    if isinstance(dtype, FRACTIONAL):
        return "double"
    return "string"


def melt(df: DataFrame, cols: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """(kept columns, column, value) for columns of one family; nulls stay."""
    keep = keep or {}
    to = family(df.schema[cols[0]].dataType)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast(to).alias("value")) for c in cols])
    slim = df.select(*[e.alias(n) for n, e in keep.items()], F.explode(cells).alias("_c"))
    return slim.select(*[ref(n) for n in keep], "_c.column", "_c.value")


def by_family(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(family(df.schema[c].dataType), []).append(c)
    return groups


def value_counts(
    df: DataFrame, cols: list[str], stats: dict[str, Column] | None = None, keep: dict[str, Column] | None = None
) -> DataFrame:
    """(column, value, n, stats...) for columns of one family. Counted per task first, so hot values are cheap."""
    return (
        melt(df, cols, keep)
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in (stats or {}).items()])
    )


def top(counts: DataFrame, k: int) -> DataFrame:
    """k most frequent non-null values per column, ties to the smaller value; adds ``rank`` from 1.

    Spark keeps k rows per column in every task before the exchange (WindowGroupLimit).
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties to the smallest; one row per column reaches the driver."""
    out: dict[str, object] = {c: None for c in cols}
    for group in by_family(df, cols).values():
        counts = value_counts(df, group).filter(F.col("value").isNotNull())
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best"))
        out.update({r["column"]: r["best"]["value"] for r in best.collect()})
    return out
