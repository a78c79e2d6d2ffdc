"""A choice among many ordered conditions as a decision tree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def choose(conds: list[Column], leaves: list[Column]) -> Column:
    """Leaf i, where i is the number of conditions that hold; they must hold in order, the first ones first.

    A decision tree: a row meets about log2 of the conditions, and it compiles to plain branches.
    """

    def grow(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaves[lo]
        mid = (lo + hi) // 2
        return F.when(conds[mid], grow(mid + 1, hi)).otherwise(grow(lo, mid))

    return grow(0, len(conds))
