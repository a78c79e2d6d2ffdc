"""A fitted treatment of one column: everything needed to repeat it on other rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.lookup import Lookup

PHASES = ("sentinels", "outliers", "missing", "encoding", "transformations")


@dataclass
class Step:
    phase: str
    column: str
    strategy: str
    params: dict[str, float] = field(default_factory=dict)
    mapping: dict[str, str] = field(default_factory=dict)
    lookup: Lookup | None = None
