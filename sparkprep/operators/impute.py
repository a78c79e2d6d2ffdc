"""Missing-value treatments: fitted fill values, applied as one projection."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import agg, counts, order, quantiles
from ..functions.columns import INTEGRAL, kind, num, ref, replace
from ..plans.step import Step

# Fill values of the constant strategy.
NUMERIC_CONSTANT = -222.0
TEXT_CONSTANT = "Unknown"

ALIASES = {"model": "median_or_mode", "model_based": "median_or_mode", "drop": "drop_column"}


def fit(df: DataFrame, strategies: dict[str, str], constants: dict | None = None, mode: str = "exact") -> list[Step]:
    """Fill values: one aggregate for the means, one quantile fit for the medians, one count for the modes."""
    constants = constants or {}
    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    plan: dict[str, str] = {}
    for c, s in strategies.items():
        s = ALIASES.get(s, s)
        is_num = kinds[c] == "numeric"
        if s not in ("mean", "median", "mode", "constant", "zero", "drop_column", "keep"):
            s = "median" if is_num else "mode"
        if s in ("mean", "median") and not is_num:
            s = "mode"
        plan[c] = s
    of = lambda *names: [c for c, s in plan.items() if s in names]
    means = agg.fit(df, {c: F.avg(num(c)) for c in of("mean")}) if of("mean") else {}
    medians = quantiles.fit(df, of("median"), [0.5], mode)
    modes = counts.modes(df, of("mode")) if of("mode") else {}
    steps = []
    for c, s in plan.items():
        is_num = kinds[c] == "numeric"
        value = None
        if s == "mean":
            value = means[c]
        elif s == "median":
            value = medians[c][0]
        elif s == "mode":
            value = modes[c] if modes[c] is not None else (0.0 if is_num else "")
        elif s == "constant":
            value = constants.get(c, NUMERIC_CONSTANT if is_num else TEXT_CONSTANT)
        elif s == "zero":
            value = 0.0 if is_num else ""
        step = Step("missing", c, s)
        if value is not None:
            whole = isinstance(df.schema[c].dataType, INTEGRAL) and _whole(value)
            if whole or not is_num:
                step.mapping["fill"] = str(int(value)) if whole else str(value)
            else:
                step.params["fill"] = float(value)
        steps.append(step)
    return steps


def _whole(value: object) -> bool:
    """Whether a fill value is a whole number; such a value of a whole-number column is kept as text, so no digit is lost."""
    return int(value) == value if isinstance(value, (int, float)) and math.isfinite(value) else str(value).lstrip("-").isdigit()


def expr(step: Step, dtype: T.DataType) -> Column:
    """Filled column. A whole-number column keeps its type and digits; only a fractional fill value turns it to double."""
    c = ref(step.column)
    if "fill" in step.mapping:
        return F.coalesce(c, F.lit(step.mapping["fill"]).cast(dtype))
    if "fill" not in step.params:
        return c
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DoubleType) and float(step.params["fill"]).is_integer():
        return F.coalesce(c, F.lit(step.params["fill"]).cast(dtype))
    return F.coalesce(num(step.column), F.lit(step.params["fill"]))


def _fill(df: DataFrame, steps: list[Step]) -> DataFrame:
    gone = [s.column for s in steps if s.strategy == "drop_column"]
    new = {s.column: expr(s, df.schema[s.column].dataType) for s in steps if s.column not in gone}
    return replace(df, new).drop(*gone)


def apply(df: DataFrame, strategies: dict[str, str], constants: dict | None = None, mode: str = "exact") -> DataFrame:
    """Named strategy per column. Columns without nulls are left alone, except those to drop."""
    nulls = agg.fit(df, {c: agg.count_if(ref(c).isNull()) for c in strategies})
    todo = {c: s for c, s in strategies.items() if nulls[c] > 0 or ALIASES.get(s, s) == "drop_column"}
    return _fill(df, fit(df, todo, constants, mode)) if todo else df


def mean(df: DataFrame, cols: list[str]) -> DataFrame:
    return _fill(df, fit(df, {c: "mean" for c in cols}))


def median(df: DataFrame, cols: list[str], mode: str = "exact") -> DataFrame:
    return _fill(df, fit(df, {c: "median" for c in cols}, mode=mode))


def median_of_clipped(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values clipped to the quantiles lo and hi, and gaps filled with the median of the clipped values, from one fit.

    Clipping keeps the order of values, so the neighbours of the clipped median are the clipped neighbours of the median.
    """
    got, _ = quantiles.neighbours(df, cols, [lo, 0.5, hi])
    new = {}
    for c, found in got.items():
        if found[0] is None:
            continue
        low, high = ((1 - w) * a + w * b if a != b else a for a, b, w in (found[0], found[2]))
        before, behind, w = found[1]
        before, behind = (min(max(v, low), high) for v in (before, behind))
        fill = before if before == behind else (1 - w) * before + w * behind
        clipped = F.least(F.greatest(num(c), F.lit(low)), F.lit(high))
        new[c] = F.when(ref(c).isNotNull(), clipped).otherwise(F.lit(fill))
    return replace(df, new)


def mode(df: DataFrame, cols: list[str]) -> DataFrame:
    return _fill(df, fit(df, {c: "mode" for c in cols}))


def constant(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Given value per column; None picks the default for the type."""
    given = {c: v for c, v in values.items() if v is not None}
    return _fill(df, fit(df, {c: "constant" for c in values}, given))


def drop(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def all(df: DataFrame, cols: list[str], how: str = "mean") -> DataFrame:  # noqa: A001
    """Every column filled with its mean or with zero."""
    return _fill(df, fit(df, {c: how for c in cols}))


def ffill(df: DataFrame, cols: list[str], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Last earlier value in the given order."""
    return order.fill_forward(df, cols, order_by, partition_by or [])


def predictors(df: DataFrame, col: str, min_corr: float = 0.3) -> list[str]:
    """Numeric columns whose correlation with ``col`` is above the limit."""
    names = [f.name for f in df.schema.fields if kind(f.dataType) == "numeric" and f.name != col]
    if not names:
        return []
    r = agg.fit(df, {c: agg.corr(num(c), num(col)) for c in names})
    return [c for c in names if r[c] is not None and abs(r[c]) > min_corr]


def model(df: DataFrame, col: str, min_corr: float = 0.3) -> DataFrame:
    """Linear regression on the correlated columns; the median where there is none or an input is missing."""
    middle = quantiles.fit(df, [col], [0.5])[col][0]
    fallback = F.lit(middle)
    inputs = predictors(df, col, min_corr)
    if not inputs:
        return replace(df, {col: F.coalesce(num(col), fallback)})
    known = df.select(num(col).alias("_y"), *[num(c).alias(f"_x{i}") for i, c in enumerate(inputs)]).dropna()
    names = [f"_x{i}" for i in range(len(inputs))]
    train = VectorAssembler(inputCols=names, outputCol="_f").transform(known)
    fitted = LinearRegression(featuresCol="_f", labelCol="_y").fit(train)
    guess = F.lit(float(fitted.intercept))
    for c, w in zip(inputs, fitted.coefficients.toArray()):
        guess = guess + num(c) * F.lit(float(w))
    return replace(df, {col: F.coalesce(num(col), guess, fallback)})
