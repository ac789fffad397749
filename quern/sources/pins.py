"""Named in-memory copies of selected columns."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

LEVELS = {"memory": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK}


class Pins:
    """A registry of persisted tables.

    Spark answers any plan over the same source and columns from the copy, and
    skips its batches by their minimum and maximum.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._held = spark, {}

    def pin(self, name: str, df: DataFrame, columns=None, level: str = "memory_and_disk") -> DataFrame:
        """Hold ``columns`` of ``df`` as view ``name``; filled when first read."""
        if level not in LEVELS:
            raise ValueError(f"level is one of {sorted(LEVELS)}")
        if name in self._held:
            raise ValueError(f"{name} is pinned already")
        held = (df.select(*columns) if columns else df).persist(LEVELS[level])
        held.createOrReplaceTempView(name)
        self._held[name] = held
        return held

    def unpin(self, name: str) -> None:
        if name not in self._held:
            raise KeyError(f"{name} is not pinned")
        self._held.pop(name).unpersist()
        self._spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self._held)

    def reset(self) -> None:
        for name in self.names():
            self.unpin(name)
