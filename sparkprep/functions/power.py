"""Power transforms and the search for their exponent.

The likelihood of an exponent needs only the variance of the transformed column and a sum of logarithms, its first two
derivatives the covariances with the transform's derivatives. One read gives them for every column at one exponent each.
The likelihood has one peak, so the sign of its slope tells on which side of the exponent the peak lies, and a Newton
step goes there; a step that leaves the bracket, or has no peak ahead, is halved instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import agg
from .columns import num

LOW, HIGH = -5.0, 5.0
NEAR = 1e-3  # so near to a hole of the closed forms they lose digits
CLOSE = 2e-3  # a Newton step so short leaves an error of its square
MOST = 20


def box_cox(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.ln(x)
    out = F.expm1(F.lit(lam) * F.ln(x)) / F.lit(lam)  # ln of 0 is null here
    return F.when(x == 0, F.lit(-1 / lam)).otherwise(out) if lam > 0 else out


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else F.expm1(F.lit(lam) * F.log1p(x)) / F.lit(lam)
    rest = 2.0 - lam
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -F.expm1(F.lit(rest) * F.log1p(-x)) / F.lit(rest)
    return F.when(x >= 0, up).otherwise(down)


def _slopes(x: Column, lam: float, family: str) -> tuple[Column, Column, Column]:
    """The transformed value and its first two derivatives by the exponent, which must not be 0 (nor 2 for Yeo-Johnson)."""

    def parts(u: Column, p: float) -> tuple[Column, Column, Column]:
        grown = F.exp(F.lit(p) * u)
        t = F.expm1(F.lit(p) * u) / F.lit(p)
        first = (u * grown - t) / F.lit(p)
        return t, first, (u * u * grown - F.lit(2.0) * first) / F.lit(p)

    if family == "box_cox":
        return parts(F.ln(x), lam)
    up, down = parts(F.log1p(x), lam), parts(F.log1p(-x), 2.0 - lam)
    return tuple(F.when(x >= 0, a).otherwise(b) for a, b in zip(up, (-down[0], down[1], -down[2])))


def _off(lam: float, family: str) -> float:
    """The exponent, moved off the places where the closed forms divide by zero."""
    for hole in (0.0, 2.0) if family != "box_cox" else (0.0,):
        if abs(lam - hole) < NEAR:
            return hole + (NEAR if lam >= hole else -NEAR)
    return lam


def fit(df: DataFrame, cols: list[str], family: str) -> dict[str, float | None]:
    """Exponent with the highest likelihood per column between LOW and HIGH; None when the column is constant or empty,
    and for Box-Cox when a value is not positive, which leaves no likelihood."""
    if not cols:
        return {}
    at, low, high = dict.fromkeys(cols, 1.0), dict.fromkeys(cols, LOW), dict.fromkeys(cols, HIGH)
    best: dict[str, float | None] = dict.fromkeys(cols)
    sums: dict = {}
    live = list(cols)
    for _ in range(MOST):
        exprs = {}
        for c in live:
            x = num(c)
            t, first, second = _slopes(x, at[c], family)
            exprs[c, "var"], exprs[c, "cov"] = F.var_pop(t), F.covar_pop(t, first)
            exprs[c, "var1"], exprs[c, "cov2"] = F.var_pop(first), F.covar_pop(t, second)
            if c not in sums:
                exprs[c, "n"], exprs[c, "s"] = F.count(x), F.sum(F.ln(x) if family == "box_cox" else F.signum(x) * F.log1p(F.abs(x)))
                exprs[c, "min"] = F.min(x)
        got = agg.fit(df, exprs)
        for c in list(live):
            if c not in sums:
                sums[c] = got[c, "n"], got[c, "s"]
                beyond = family == "box_cox" and got[c, "min"] is not None and got[c, "min"] <= 0
                if beyond or not sums[c][0] or sums[c][1] is None or not got[c, "var"] or not math.isfinite(got[c, "var"]):
                    live.remove(c)
                    continue
            here, (n, total) = at[c], sums[c]
            var, *rest = (got[c, k] for k in ("var", "cov", "var1", "cov2"))
            usable = all(v is not None and math.isfinite(v) for v in (var, *rest)) and var > 0
            slope, new = 1.0 - here, None  # too far out for doubles: the peak lies nearer to the start
            if usable:
                cov, var1, cov2 = rest
                slope = total - n * cov / var
                bend = -n * ((var1 + cov2) / var - 2 * (cov / var) ** 2)
                if (here >= HIGH and slope > 0) or (here <= LOW and slope < 0):
                    best[c] = here
                    live.remove(c)
                    continue
                if bend < 0:
                    new = min(max(here - slope / bend, LOW), HIGH)
            low[c], high[c] = (here, high[c]) if slope > 0 else (low[c], here)
            if new is None or not low[c] <= new <= high[c]:
                new = (low[c] + high[c]) / 2
            best[c] = new
            if (usable and abs(new - here) <= CLOSE) or high[c] - low[c] <= CLOSE:
                live.remove(c)
            at[c] = _off(new, family)
        if not live:
            break
    return best
