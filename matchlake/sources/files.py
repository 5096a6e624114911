"""File scans and sinks. Compressed input (gzip) is decoded by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in a single column ``value``."""
    return spark.read.text(path)


def read_match_records(spark: SparkSession, path: str, *player_fields: str) -> DataFrame:
    """Projected JSON scan: match id plus only the player fields a job needs."""
    schema = schemas.narrow_raw_match(*player_fields)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(index, vec, val, size) rows from comma-separated text."""
    return spark.read.schema(schemas.TRIPLES).option("mode", "FAILFAST").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("errorifexists").option("header", header).csv(path)


def write_key_values(df: DataFrame, key: str, value: str, path: str) -> None:
    """Tab-separated key and value, one pair per line."""
    text = F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))
    df.select(text.alias("value")).write.mode("errorifexists").text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """Parquet by day, so that jobs over a date range read only its folders."""
    day = F.to_date(F.timestamp_millis("start_ms"))
    matches.withColumn("day", day).write.mode("errorifexists").partitionBy("day").parquet(path)
