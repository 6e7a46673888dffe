"""Append-only tables and versioned publication."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .publication import Conflict, DuplicateRows, Releases, Table  # noqa: F401


def stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``, with a log of its changes or without, empty if nothing has been written there."""
    table = Table(spark, path, StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    if table.log.number():
        return table.read()
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def content_id(*columns: str) -> Column:
    """A hash that identifies a row by the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append rows whose key the table does not hold; of rows with one key, one. Two writers never double a key."""
    Table(rows.sparkSession, path, rows.schema).append_new(rows, key)


def append_once(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append rows; DuplicateRows if a key occurs twice or is there already, and nothing is written."""
    Table(rows.sparkSession, path, rows.schema).append_once(rows, key)


def publish(rows: DataFrame, root: str, version: str) -> None:
    """Publish a version of a table; an existing one is a Conflict."""
    Releases(rows.sparkSession, root).publish(rows, version)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version that was published last, found by the log alone."""
    return Releases(spark, root).current()


def retained(artifacts: DataFrame, keep: int) -> DataFrame:
    """Artifacts (path, written_at, champion) to delete: all but the newest ``keep`` and the champions."""
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("written_at"), "path"))
    return artifacts.withColumn("k", rank).where((F.col("k") > keep) & ~F.col("champion")).drop("k")


def finite(rows: DataFrame) -> DataFrame:
    """The rows with NaN and infinite values as nulls, as JSON has neither."""
    real = [c for c, t in rows.dtypes if t in ("double", "float")]
    return rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in real})


def as_json(rows: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """One JSON text for each row, next to its keys; characters of other scripts stay as they are, nulls are left out."""
    return finite(rows).select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias(name))


def token_sums(usage: Column) -> tuple[Column, Column]:
    """Input and output tokens of a run's usage by role (a map of structs)."""
    total = lambda c: F.aggregate(F.map_values(usage), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[c], F.lit(0).cast("long")))
    return total("input_tokens"), total("output_tokens")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under ``path``, one a file, with the file's name; none where nothing has been written. Broken ones have null fields."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, name string")
    return rows.withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def reload_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with its header, dates and booleans read by the schema; empty if it has not been written."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
