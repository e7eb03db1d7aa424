"""How far a job has come: rows counted as they pass, without jobs of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Counts rows that pass named points of a plan, and tells a callback of what has passed so far and of all there is.

    A point's numbers are known when the action that passes it has ended; asking earlier waits for it. A task
    that is run again is counted once.
    """

    def __init__(self, callback: Callable[[int, int], None] | None = None, total: int = 0):
        self.callback, self.total, self.done = callback, total, 0
        self.points: dict[str, Observation] = {}

    def watched(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """df, whose rows are counted on their way as `rows`, beside further aggregates."""
        self.points[name] = Observation(name)
        return df.observe(self.points[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])

    def at(self, name: str) -> dict[str, int]:
        return self.points[name].get

    def advance(self, n: int) -> None:
        """n more are done."""
        self.done += n
        if self.callback:
            self.callback(self.done, self.total)
