"""What a run did, step by step: rows and seconds without jobs of their own, errors and counters that add up.

A step's frame is materialised in the shared folder (as long plans are anyway)
with an Observation on it, so its rows are counted by the job that writes them.

Defined cases: a step without rows has 0; a step that fails is logged with its
error and raised again; equal names are steps of their own, in order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.lineage import cut

SCHEMA = "place int, step string, rows long, seconds double, error string"


class StepLog:
    """Steps, errors and counters of one run."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []
        self.errors: list[str] = []
        self.counters: dict[str, int] = {}

    def step(self, name: str, make: Callable[[], DataFrame] | DataFrame) -> DataFrame:
        """The frame, materialised and logged; seconds include the building of its plan where ``make`` is a callable."""
        began = time.perf_counter()
        try:
            df = make() if callable(make) else make
            seen = Observation()
            out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        except Exception as e:
            self._add(name, None, began, f"{type(e).__name__}: {e}")
            raise
        self._add(name, seen.get["rows"], began, None)
        return out

    def _add(self, name: str, rows: int | None, began: float, error: str | None) -> None:
        self.steps.append((len(self.steps) + 1, name, rows, round(time.perf_counter() - began, 3), error))
        if error:
            self.errors.append(f"{name}: {error}")

    def fail(self, message: str) -> None:
        """An error that doesn't end the run."""
        self.errors.append(message)

    def count(self, name: str, n: int | None = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + int(n or 0)

    def merge(self, other: StepLog) -> StepLog:
        """Both logs: steps and errors one after the other, counters added."""
        out = StepLog()
        out.steps = [(k + 1, *s[1:]) for k, s in enumerate(self.steps + other.steps)]
        out.errors = self.errors + other.errors
        for log in (self, other):
            for name, n in log.counters.items():
                out.count(name, n)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """place, step, rows, seconds, error: one row per step."""
        return spark.createDataFrame(self.steps, SCHEMA)
