"""A stage against a slow form of itself: equal rows, and the time that each takes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from occasio.sources.tables import content_digest


@dataclass(frozen=True)
class Comparison:
    stage: str
    rows: int
    fast_seconds: float
    slow_seconds: float

    @property
    def speedup(self) -> float:
        return self.slow_seconds / max(self.fast_seconds, 1e-9)


def compare(stage: str, fast: Callable[[], DataFrame], slow: Callable[[], DataFrame]) -> Comparison:
    """Run both in full; rows that differ, whatever their order, raise."""
    got = []
    for build in (fast, slow):
        began = time.perf_counter()
        df = build()
        digest = content_digest(df.select(*sorted(df.columns))).first()
        got.append((sorted(df.columns), digest["n_rows"], digest["digest"], time.perf_counter() - began))
    if got[0][:3] != got[1][:3]:
        raise ValueError(f"{stage}: the two forms differ: {got[0][1]} rows and {got[1][1]} rows")
    return Comparison(stage, got[0][1], got[0][3], got[1][3])
