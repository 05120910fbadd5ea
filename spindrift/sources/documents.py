"""JSON documents from files, one text in each row, and typed records from those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import JsonType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): one JSON document in each line."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): one JSON document in each file."""
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))


def elements(df: DataFrame, column: str) -> DataFrame:
    """Rows of root arrays taken apart, one for each element; other documents stay one row."""
    parts = F.when(F.col(column).rlike(r"^\s*\["), F.from_json(column, "array<variant>")).otherwise(F.array(F.try_parse_json(column)))
    return df.withColumn(column, F.explode(parts)).withColumn(column, F.to_json(column))


def typed(df: DataFrame, column: str, schema: JsonType) -> DataFrame:
    """Adds record: the document as a struct of the schema; columns that aren't used aren't parsed."""
    return df.withColumn("record", F.from_json(column, schema.to_spark()))
