"""SQL and labels over a session, pins and vector search in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.vector import VectorIndexes
from quern.sources.pins import Pins
from quern.sources.tables import TABLES, Tables


class Engine:
    """``sql`` takes Spark SQL; named parameters are bound, never pasted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.pins, self.indexes = spark, Pins(spark), VectorIndexes(spark)

    def register(self, folder: str, names=TABLES) -> None:
        """Make the tables of a folder views."""
        tables = Tables(self.spark, folder)
        for name in names:
            getattr(tables, name).createOrReplaceTempView(name)

    def sql(self, text: str, label: str | None = None, **args) -> DataFrame:
        if label is not None:
            self.label(label)
        return self.spark.sql(text, args=args or None)

    def label(self, text: str) -> None:
        """What the jobs that follow are called in Spark's listings."""
        self.spark.sparkContext.setJobDescription(text)

    def reset(self) -> None:
        """Drop all pins and what else the session keeps in memory."""
        self.pins.reset()
        self.spark.catalog.clearCache()
