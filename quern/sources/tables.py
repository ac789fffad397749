"""Relations to read: Parquet files, literal rows, and files with deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a folder as attributes, read when they are first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_parquet(self._spark, f"{self._folder}/{name}.parquet")


def read_parquet(spark: SparkSession, *paths: str, base_path: str | None = None) -> DataFrame:
    """Files, folders or globs; partition folders ``key=value`` become columns below ``base_path``."""
    reader = spark.read if base_path is None else spark.read.option("basePath", base_path)
    return reader.parquet(*paths)


def with_file_columns(df: DataFrame) -> DataFrame:
    """Adds ``filename``, ``file_row_number`` and ``file_index`` of rows read from files.

    Files are numbered in the order of their paths, from 0. The list of files is
    a table of one row per file.
    """
    placed = df.withColumns({"filename": F.col("_metadata.file_path"), "file_row_number": F.col("_metadata.row_index")})
    files = df.select(F.col("_metadata.file_path").alias("filename")).distinct()
    files = files.withColumn("file_index", F.row_number().over(Window.orderBy("filename")).cast("long") - 1)
    return placed.join(files, "filename")


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def one_row(spark: SparkSession) -> DataFrame:
    """One row without columns to compute constants over."""
    return spark.range(1).select()


def without_deleted(df: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows of files that no positional delete names.

    ``df`` has filename and file_row_number (see with_file_columns), ``deletes``
    file_path and pos: the row-level deletes of table formats.
    """
    gone = deletes.select(F.col("file_path").alias("filename"), F.col("pos").alias("file_row_number"))
    return df.join(gone, ["filename", "file_row_number"], "left_anti")


def read_csv(spark: SparkSession, path: str, schema, header: bool = True, **options) -> DataFrame:
    """Rows of delimited text. The schema is given, so that nothing is read twice to infer it; a bad field fails."""
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=False, mode="FAILFAST", **options)


def read_json(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Rows of JSON, one object a line, by a given schema."""
    return spark.read.json(path, schema=schema, mode="FAILFAST", **options)
