"""The match import over a folder that keeps growing.

Each run takes the files it has not seen, so match files are imported once as
the downloader writes them. The parsing is the batch one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def import_new_files(
    spark: SparkSession,
    source: str,
    matches: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append the matches of new files to a table by day, then stop.

    ``checkpoint`` is a folder all executors share; it holds the list of files
    done, which makes a repeated or restarted run append nothing twice.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    rows = ingest.ingest_matches(lines)
    day = F.to_date(F.timestamp_millis("start_ms"))
    return (
        rows.withColumn("day", day)
        .writeStream.format("parquet")
        .option("path", matches)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )
