"""Outlier and sentinel treatments: fitted fences, applied as one projection or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import agg, quantiles
from ..functions.columns import num, numeric, ref, replace
from ..plans.step import Step

# Numbers that stand for "missing" in exported tables, and the magnitudes beyond which a
# number is taken for a default rather than a measurement.
SENTINELS = (-999999.0, 999999.0, -9999.0, 9999.0, -1.7e308)
SENTINEL_SIZES = (1.79769313486e308, 2.22507385851e-308)
ABS_LIMIT = 1e14
LOW_LIMIT, HIGH_LIMIT = -1e12, 1e12

# strategy -> (what happens, probabilities of the fitted bounds; None = interquartile fences)
_RULES = {
    "winsorize": ("clip", (0.01, 0.99)),
    "winsorize_5_95": ("clip", (0.05, 0.95)),
    "null_iqr": ("null", None),
    "null_pct": ("null", (0.01, 0.99)),
    "drop_rows": ("drop", None),
    "center_median": ("center", (0.01, 0.99)),
    "center_mean": ("center", (0.01, 0.99)),
    "keep": ("keep", ()),
}
ALIASES = {
    "clip": "winsorize",
    "clip_percentile": "winsorize",
    "winsorize_1st_99th": "winsorize",
    "mark_missing": "null_iqr",
    "remove": "drop_rows",
}


def _is_sentinel(c: Column) -> Column:
    return (
        (F.abs(c) > ABS_LIMIT)
        | (c < LOW_LIMIT)
        | (c > HIGH_LIMIT)
        | c.isin(*SENTINELS)
        | F.abs(c).isin(*SENTINEL_SIZES)
    )


def sentinels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Infinities, out-of-range magnitudes and stand-in numbers -> null."""
    cols = numeric(df) if cols is None else cols
    return replace(df, {c: F.when(~_is_sentinel(num(c)), ref(c)) for c in cols})


def sentinel_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n, pct, infinities, extreme_negative, extreme_positive, default_double), affected columns only."""
    cols = numeric(df) if cols is None else cols
    inf = float("inf")
    out = agg.long(
        df,
        {
            c: {
                "n": agg.count_if(_is_sentinel(num(c))),
                "pct": agg.pct(agg.count_if(_is_sentinel(num(c))), F.count(F.lit(1))),
                "infinities": agg.count_if(num(c).isin(inf, -inf)),
                "extreme_negative": agg.count_if(num(c) < -1e100),
                "extreme_positive": agg.count_if(num(c) > 1e100),
                "default_double": agg.count_if(F.abs(num(c)) > 1e300),
            }
            for c in cols
        },
    )
    return out.filter(F.col("n") > 0)


def fit(df: DataFrame, strategies: dict[str, str], mode: str = "exact", k: float = 1.5) -> list[Step]:
    """Fences for every column: one quantile fit for all columns with the same probabilities."""
    wanted: dict[tuple, list[str]] = {}
    named = {c: ALIASES.get(s, s) for c, s in strategies.items()}
    for c, s in named.items():
        if s not in _RULES:
            raise ValueError(f"unknown outlier strategy {s!r} for {c}")
        act, probs = _RULES[s]
        probs = (0.25, 0.75) if probs is None else probs
        if s == "center_median":
            probs = probs + (0.5,)
        if probs:
            wanted.setdefault(probs, []).append(c)
    found: dict[str, list] = {}
    for probs, cols in wanted.items():
        found.update(quantiles.fit(df, cols, list(probs), mode))
    means = {c: F.avg(num(c)) for c, s in named.items() if s == "center_mean"}
    centers = agg.fit(df, means) if means else {}
    steps = []
    for c, s in named.items():
        params: dict[str, float] = {}
        got = found.get(c)
        if got and got[0] is not None:
            lo, hi = quantiles.fences(got[0], got[1], k) if _RULES[s][1] is None else (got[0], got[1])
            params = {"lo": lo, "hi": hi}
            if _RULES[s][0] == "center":
                params["center"] = got[2] if s == "center_median" else centers[c]
        steps.append(Step("outliers", c, s, params))
    return steps


def expr(step: Step) -> Column:
    """The treated column. Nulls stay null: ``least``/``greatest`` would turn them into a bound."""
    c = ref(step.column)
    act = _RULES[step.strategy][0]
    if act in ("keep", "drop") or not step.params:
        return c
    x, lo, hi = num(step.column), F.lit(step.params["lo"]), F.lit(step.params["hi"])
    if act == "clip":
        return F.when(c.isNotNull(), F.least(F.greatest(x, lo), hi))
    if act == "null":
        return F.when(x.between(lo, hi), c)
    return F.when(x.between(lo, hi) | c.isNull(), x).otherwise(F.lit(step.params["center"]))


def row_filter(step: Step) -> Column | None:
    """Rows kept by a step that removes rows; rows without a value go as well."""
    if _RULES[step.strategy][0] != "drop" or not step.params:
        return None
    return num(step.column).between(step.params["lo"], step.params["hi"])


def _run(df: DataFrame, cols: list[str], strategy: str, mode: str = "exact") -> DataFrame:
    return replace(df, {s.column: expr(s) for s in fit(df, {c: strategy for c in cols}, mode)})


def winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99, mode: str = "exact") -> DataFrame:
    """Clip to the quantiles lo and hi."""
    if (lo, hi) == (0.01, 0.99):
        return _run(df, cols, "winsorize", mode)
    found = quantiles.fit(df, cols, [lo, hi], mode)
    steps = [Step("outliers", c, "winsorize", {"lo": b[0], "hi": b[1]} if b[0] is not None else {}) for c, b in found.items()]
    return replace(df, {s.column: expr(s) for s in steps})


def to_null(df: DataFrame, cols: list[str], rule: str = "iqr", mode: str = "exact") -> DataFrame:
    """Values outside the interquartile fences (``iqr``) or the 1st/99th percentile (``pct``) -> null."""
    return _run(df, cols, {"iqr": "null_iqr", "pct": "null_pct"}[rule], mode)


def to_center(df: DataFrame, cols: list[str], center: str = "median", mode: str = "exact") -> DataFrame:
    """Values outside the 1st/99th percentile -> the mean or median of the column."""
    return _run(df, cols, f"center_{center}", mode)


def fit_drop(df: DataFrame, cols: list[str], sequential: bool = True, mode: str = "exact") -> list[Step]:
    """Fences for row removal. Sequential: those of a column come from the rows the earlier columns kept."""
    if not sequential:
        return fit(df, {c: "drop_rows" for c in cols}, mode)
    steps: list[Step] = []
    for c in cols:
        kept = df
        for s in steps:
            cond = row_filter(s)
            kept = kept if cond is None else kept.filter(cond)
        steps += fit(kept, {c: "drop_rows"}, mode)
    return steps


def drop_rows(df: DataFrame, cols: list[str], sequential: bool = True, mode: str = "exact") -> DataFrame:
    """Keep rows inside the interquartile fences of every column."""
    for s in fit_drop(df, cols, sequential, mode):
        cond = row_filter(s)
        df = df if cond is None else df.filter(cond)
    return df
