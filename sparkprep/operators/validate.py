"""Checks a table must pass before anything is fitted on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import agg
from ..functions.columns import ref


def table(df: DataFrame, min_rows: int = 10, min_cols: int = 2) -> DataFrame:
    """(check, ok, detail) for: not empty, enough rows, enough columns, no all-null column."""
    names = df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[(F.count(ref(c)) == 0).alias(f"empty_{i}") for i, c in enumerate(names)],
    )
    flags = [F.when(F.col(f"empty_{i}"), F.lit(c)) for i, c in enumerate(names)]
    empty = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    rows = F.col("rows")
    checks = [
        ("not_empty", rows > 0, F.concat(rows.cast("string"), F.lit(" rows"))),
        ("min_rows", rows >= min_rows, F.concat(rows.cast("string"), F.lit(f" of {min_rows} rows"))),
        ("min_cols", F.lit(len(names) >= min_cols), F.lit(f"{len(names)} of {min_cols} columns")),
        ("no_empty_column", F.size(empty) == 0, F.array_join(empty, ", ")),
    ]
    return one.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.alias("detail")) for n, ok, d in checks])
        )
    )
