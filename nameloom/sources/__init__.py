"""Sources of names and sinks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def names_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """name_id, name of the non-empty lines of text files; a carriage return at
    the end goes.  Ids are unique, not consecutive."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r+$", "").alias("name")).where("name <> ''")
    return lines.select(F.monotonically_increasing_id().alias("name_id"), "name")


def names_from_list(spark: SparkSession, names: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(names)], "name_id long, name string")


def names_from_table(df: DataFrame, name: Column, name_id: Column) -> DataFrame:
    return df.select(name_id.cast("long").alias("name_id"), name.cast("string").alias("name"))


def write_records(records: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = records.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_dicts(records: DataFrame, path: str, evidence: bool = False, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    from ..operators.result import to_dict

    to_dict(records, evidence).select("dict").write.mode(mode).text(path)
