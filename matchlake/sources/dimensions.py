"""Id-to-name dimensions from JSON documents such as ``{"heroes": [{"id": 1, ...}]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import checkpoint

# Largest table a lookup broadcasts.
MAX_LOOKUP_ROWS = 10_000
# Largest one by bytes, where they are known.
MAX_LOOKUP_BYTES = 64 << 20
# What a row takes in a hash table beside its values.
_ROW_BYTES = 32

HERO_DOCUMENT = "count INT, heroes ARRAY<STRUCT<localized_name: STRING, name: STRING, id: INT>>"
ITEM_DOCUMENT = "items ARRAY<STRUCT<id: INT, name: STRING>>"


def lookup(table: DataFrame) -> DataFrame:
    """Broadcast a table that is small, which is checked; else leave the join to Spark."""
    small = table.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS
    return F.broadcast(table) if small else table


def settle(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` of plain columns, written once, and its size in bytes, which that write observes."""
    width = F.lit(_ROW_BYTES + 8 * len(table.columns))
    for field in table.schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    seen = Observation()
    written = checkpoint(table.observe(seen, F.sum(width).alias("bytes")))
    return written, seen.get["bytes"] or 0


def names(documents: DataFrame, schema: str, container: str, id_column: str, name_field: str) -> DataFrame:
    """(id_column, name) rows of the list ``container`` in each JSON document."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return documents.select(F.explode(parsed[container]).alias("entry")).select(
        F.col("entry.id").alias(id_column), F.col(f"entry.{name_field}").alias("name")
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one per row."""
    return spark.read.text(path, wholetext=True)


def hero_names(documents: DataFrame) -> DataFrame:
    return names(documents, HERO_DOCUMENT, "heroes", "hero_id", "localized_name")


def item_names(documents: DataFrame) -> DataFrame:
    return names(documents, ITEM_DOCUMENT, "items", "item_id", "name")
