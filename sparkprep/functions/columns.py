"""Column references, type families and NaN handling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def ref(name: str) -> Column:
    """Column by exact name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    return ref(name).cast("double")


def kind(dtype: T.DataType) -> str:
    """numeric, boolean, categorical, datetime or other."""
    if isinstance(dtype, INTEGRAL + FRACTIONAL):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    return "other"


def of_kind(df: DataFrame, wanted: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if kind(f.dataType) == wanted and f.name not in skip]


def numeric(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return of_kind(df, "numeric", exclude)


def categorical(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return of_kind(df, "categorical", exclude)


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in float and double columns. NaN sorts above every number and poisons averages."""
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the named columns in place and appends unknown names."""
    kept = [new[n].alias(n) if n in new else ref(n) for n in df.columns]
    added = [e.alias(n) for n, e in new.items() if n not in df.columns]
    return df.select(*kept, *added)


def any_of(text: Column, parts: Iterable[str]) -> Column:
    """True when the text contains one of the literal parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out
