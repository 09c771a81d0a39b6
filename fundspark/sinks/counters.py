"""Load counters that ride along with the job they count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get["rows"]`` is filled by the first action."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


class Counters:
    """Row counts of a load's steps by their names, taken by the jobs that the load runs anyway."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def of(self, df: DataFrame, step: str) -> DataFrame:
        """``df``, counted as ``step`` by the first job that reads it to its end."""
        observed, self._seen[step] = counted(df, step)
        return observed

    def get(self) -> dict[str, int]:
        """The counts; waits for the load's first job."""
        return {step: seen.get["rows"] for step, seen in self._seen.items()}
