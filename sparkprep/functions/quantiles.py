"""Quantiles with linear interpolation, exact at any table size, in two or three reads.

The first read sketches every column in one aggregate: a KLL sketch is mergeable, has a fixed size, and its ranks are off by
at most ``ERROR`` of the rows with 99 % confidence, so the values at twice that distance on both sides of a wanted rank
bracket it. The second read counts the rows at and between these values, which makes the brackets certain, and, where few
rows can lie between two of them, brings back the values there with their counts, which decides the rank. Where more rows
lie between, the same read sketches them instead, and a third one decides: each sketch narrows an interval by a factor of a
hundred or more. Counts are exact, so a sketch decides only how many reads are needed.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..session import limit
from . import agg
from .columns import num, ref
from .tree import choose

EXACT_ROWS = 50_000  # default of sparkprep.exactRows: an interval of at most this many rows is read out
ALL_ROWS = 400_000  # rows that the intervals of one job may hold together to be read out
CUTS_PER_JOB = 200
ACCURACY = 10_000  # of mode="approx"
GRID = 256  # steps of a sketch within an interval
SKETCH = 16_384  # size of the sketches: some hundred kilobytes a column
ERROR = 2.296 / SKETCH**0.9021  # published bound of its normalised rank error
_SLACK = 2 * ERROR


def fit(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    mode: str = "exact",
    exact_rows: int | None = None,
    also: dict[Any, Column] | None = None,
) -> dict[Any, list[float | None]]:
    """{column: quantile per probability}; null and NaN are ignored, None for an empty column.

    ``also`` names further aggregates over ``df``; they are computed in the first read and returned under their names.
    """
    also = also or {}
    if not cols:
        return agg.fit(df, also) if also else {}
    if mode == "approx":
        slim = df.select(*[F.nanvl(num(c), F.lit(None).cast("double")).alias(c) for c in cols])
        at = F.array(*[F.lit(float(p)) for p in probs])
        got = agg.fit(slim, {c: F.percentile_approx(ref(c), at, ACCURACY) for c in cols})
        out = {c: [None] * len(probs) if v is None else [float(x) for x in v] for c, v in got.items()}
        return {**out, **(agg.fit(df, also) if also else {})}
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    got, extra = neighbours(df, cols, probs, exact_rows, also)
    out = {c: [None if x is None else x[0] if x[0] == x[1] else (1 - x[2]) * x[0] + x[2] * x[1] for x in got[c]] for c in cols}
    return {**out, **extra}


def neighbours(
    df: DataFrame, cols: list[str], probs: list[float], exact_rows: int | None = None, also: dict[Any, Column] | None = None
) -> tuple[dict[str, list[tuple[float, float, float] | None]], dict[Any, Any]]:
    """{column: (value at or before, value at or behind, share of the latter) per probability}, and the further aggregates."""
    rows = limit(df.sparkSession, "exactRows", EXACT_ROWS) if exact_rows is None else exact_rows
    places = sorted({x for p in probs for x in _around(p)})
    at = F.array(*[F.lit(x) for x in places])
    clean = {c: F.nanvl(num(c), F.lit(None).cast("double")) for c in cols}
    sketch = {}
    for c, e in clean.items():
        read = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(e, F.lit(SKETCH)), at)
        sketch["", c] = F.struct(F.count(e).alias("n"), F.when(F.count(e) > 0, read).alias("q"))
    got = agg.fit(df, {**sketch, **{("also", k): e for k, e in (also or {}).items()}})
    sizes = {c: got["", c]["n"] for c in cols}
    wanted: dict[tuple[str, int], _Rank] = {}
    for c in cols:
        if sizes[c]:
            by_place = dict(zip(places, got["", c]["q"]))
            for p in probs:
                ends = [float(by_place[x]) for x in _around(p)]
                pos = p * (sizes[c] - 1)
                for r in {math.floor(pos), math.ceil(pos)}:
                    wanted[c, r] = _Rank(c, r, ends, 2 * _SLACK * sizes[c])
    _settle(df.select(*[e.alias(c) for c, e in clean.items()]), list(wanted.values()), max(1, rows))
    out: dict[str, list[tuple[float, float, float] | None]] = {}
    for c in cols:
        spots = [p * (sizes[c] - 1) for p in probs]
        out[c] = [(wanted[c, math.floor(x)].value, wanted[c, math.ceil(x)].value, x - math.floor(x)) if sizes[c] else None for x in spots]
    return out, {k: got["also", k] for k in also or {}}


def _around(p: float) -> list[float]:
    """Places whose sketched values hold the rank at p between them; the ends of a column are kept by the sketch itself."""
    return [float(p)] if p in (0, 1) else [max(0.0, p - _SLACK), min(1.0, p + _SLACK)]


@dataclass
class _Rank:
    """A wanted position among the non-null values of a column, and values that hold it between them."""

    column: str
    rank: int  # from 0
    ends: list[float]  # one or two values; the rank lies at one of them or between
    room: float  # about how many rows can lie between
    value: float | None = None


@dataclass
class _Cuts:
    """The values of a column that one job counts against, and the gaps between them whose rows it reads or sketches.

    Region 2i + 1 is value i, region 2i the gap below it; the last one is the gap above all values.
    """

    points: list[float]
    gaps: set[int] = field(default_factory=set)
    widest: float = 0.0  # most rows that can lie in one of the gaps


def _settle(df: DataFrame, ranks: list[_Rank], exact_rows: int) -> None:
    """Finds the value of every rank; one job a round for as many columns as fit."""
    while todo := [t for t in ranks if t.value is None]:
        cuts: dict[str, _Cuts] = {}
        room: dict[str, float] = {}
        for c in dict.fromkeys(t.column for t in todo):
            own = [t for t in todo if t.column == c]
            points = sorted({v for t in own for v in t.ends})
            cuts[c] = _Cuts(points)
            for t in own:
                low, high = bisect.bisect_left(points, t.ends[0]), bisect.bisect_left(points, t.ends[-1])
                cuts[c].gaps |= {2 * i + 2 for i in range(low, high)}
            room[c] = sum({(t.ends[0], t.ends[-1]): t.room for t in own if len(t.ends) > 1}.values())
            cuts[c].widest = max(t.room for t in own)
        for part in _parts(cuts, room):
            read = all(cuts[c].widest <= exact_rows for c in part) and sum(room[c] for c in part) <= max(ALL_ROWS, exact_rows)
            found = _regions(df, {c: cuts[c] for c in part}, read)
            for t in todo:
                if t.column in part:
                    _locate(t, cuts[t.column].points, found[t.column], read)


def _parts(cuts: dict[str, _Cuts], room: dict[str, float]) -> list[list[str]]:
    """Columns of one job each: so many values to compare with, and so many rows to read out."""
    parts: list[list[str]] = []
    points = rows = 0
    for c in cuts:
        if not parts or points + len(cuts[c].points) > CUTS_PER_JOB or rows + room[c] > ALL_ROWS:
            parts.append([])
            points = rows = 0
        parts[-1].append(c)
        points, rows = points + len(cuts[c].points), rows + room[c]
    return parts


def _regions(df: DataFrame, cuts: dict[str, _Cuts], read: bool) -> dict[str, dict[int, tuple[int, list]]]:
    """{column: {region: (rows, its (value, rows) in order, or the grid of its sketch)}}; only chosen gaps have the latter."""
    cols = list(cuts)
    # the values of a row one below the other as plain numbers, and the comparisons of the column each comes from
    rows = df.select(F.posexplode(F.array(*[ref(c) for c in cols])).alias("c", "v")).filter(F.col("v").isNotNull())
    rows = rows.select("c", "v", choose([F.col("c") >= k for k in range(1, len(cols))], [_region(F.col("v"), cuts[c]) for c in cols]).alias("r"))
    chosen = F.when(F.col("r") < 0, F.col("v"))  # the number of a chosen gap comes with a minus sign
    out: dict[str, dict[int, tuple[int, list]]] = {c: {} for c in cols}
    if read:
        got = rows.groupBy("c", "r", chosen.alias("v")).count().toArrow()
        for c, r, v, k in zip(*(got.column(name).to_pylist() for name in ("c", "r", "v", "count"))):
            n, values = out[cols[c]].setdefault(abs(r), (0, []))
            values.append((v, k))
            out[cols[c]][abs(r)] = (n + k, values)
        for regions in out.values():
            for r, (n, values) in regions.items():
                regions[r] = (n, sorted(values) if values[0][0] is not None else [])
        return out
    steps = max(16, min(GRID, 1_000_000 // max(1, sum(len(x.gaps) for x in cuts.values()))))
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    inner = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(chosen, F.lit(SKETCH)), grid)
    sketched = F.when(F.count(chosen) > 0, inner).alias("q")
    for x in rows.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), sketched).collect():
        out[cols[x["c"]]][abs(x["r"])] = (x["n"], [float(v) for v in x["q"] or []])
    return out


def _region(x: Column, cuts: _Cuts) -> Column:
    """The number of the region of x, negative for a chosen gap."""

    def gap(i: int) -> Column:
        return F.lit(-i if i in cuts.gaps else i)

    leaves = [gap(0)]
    for i, v in enumerate(cuts.points):
        leaves.append(F.when(x == F.lit(v), F.lit(2 * i + 1)).otherwise(gap(2 * i + 2)))
    return choose([x >= F.lit(v) for v in cuts.points], leaves)


def _locate(t: _Rank, points: list[float], found: dict[int, tuple[int, list]], read: bool) -> None:
    """Moves a rank to the region that holds it: its value, or a narrower pair of values around it."""
    below = 0
    for r in range(2 * len(points) + 1):
        n, inner = found.get(r, (0, []))
        if t.rank < below + n:
            break
        below += n
    if r % 2:
        t.value = points[r // 2]
    elif read and inner:
        for v, n in inner:
            if t.rank < below + n:
                t.value = float(v)
                return
            below += n
    elif inner:
        steps = len(inner) - 1
        at = (t.rank - below + 0.5) / n * steps
        low, high = max(0, math.floor(at) - 1), min(steps, math.ceil(at) + 1)
        t.ends, t.room = [inner[low], inner[high]], (high - low + 1) / steps * n
    else:  # outside the values that should hold it: look at all rows there
        t.ends = [points[max(0, r // 2 - 1)], points[min(len(points) - 1, r // 2)]]
        t.room = n
        if r == 0:
            t.ends = [-math.inf, points[0]]
        elif r == 2 * len(points):
            t.ends = [points[-1], math.inf]


def fences(q1: float, q3: float, k: float = 1.5) -> tuple[float, float]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)
