"""Versioned cells in long form: (entity, qualifier, ts, value).

A map-type column family is a table of cells. Stored by qualifier, a scan for
one qualifier or a pattern reads only the matching folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["entity", "qualifier", "ts"]


def from_columns(df: DataFrame, entity: str, ts: str, **values: str) -> DataFrame:
    """Cells from typed columns: qualifier -> column name. Nulls make no cell."""
    entries = F.array(
        *(
            F.struct(F.lit(q).alias("qualifier"), F.col(c).cast("double").alias("value"))
            for q, c in values.items()
        )
    )
    return (
        df.select(
            F.col(entity).cast("long").alias("entity"),
            F.col(ts).cast("long").alias("ts"),
            F.inline(entries),
        )
        .where(F.col("value").isNotNull())
        .select(*KEY, "value")
    )


def from_map(df: DataFrame, entity: str, ts: str, family: str) -> DataFrame:
    """Cells of a whole map-type family."""
    return df.select(
        F.col(entity).cast("long").alias("entity"),
        F.col(ts).cast("long").alias("ts"),
        F.explode(family).alias("qualifier", "value"),
    ).select(*KEY, "value")


def matching(cells: DataFrame, pattern: str) -> DataFrame:
    """Cells whose whole qualifier matches a regular expression."""
    return cells.where(F.col("qualifier").rlike(f"^(?:{pattern})$"))


def latest(cells: DataFrame) -> DataFrame:
    """Newest version per entity and qualifier."""
    return cells.groupBy("entity", "qualifier").agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")
    )


def upsert(stored: DataFrame, puts: DataFrame) -> DataFrame:
    """Table after ``puts``: a put at an existing (entity, qualifier, ts) replaces the value.

    One shuffle on the key, combined before it, so a hot entity stays cheap. Of
    several puts at one key the largest value stays.
    """
    before = stored.select(*KEY, F.col("value").alias("old"), F.lit(None).cast("double").alias("new"))
    after = puts.select(*KEY, F.lit(None).cast("double").alias("old"), F.col("value").alias("new"))
    return (
        before.unionByName(after)
        .groupBy(*KEY)
        .agg(F.coalesce(F.max("new"), F.max("old")).alias("value"))
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*KEY, "value")


def write(cells: DataFrame, path: str) -> None:
    """One folder per qualifier."""
    cells.write.mode("errorifexists").partitionBy("qualifier").parquet(path)
