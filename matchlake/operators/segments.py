"""Order-preserving splits of large groups, for window operators.

A window over an entity puts all of the entity's rows into one task. One
entity may hold a large part of a table, so its rows are first cut along the
order column into segments that keep the order. Windows then run per
(entity, segment), and what a segment needs from earlier ones (a row count, a
last value) is carried over from a summary of the segments.

Only entities above ``1 / MAX_SHARE`` of all rows are cut. Segments are even
along the order column and numbered by their lowest value; those that still hold too
many rows, where games come in bursts, are cut again until they fit or hold a single
value. At most MAX_SHARE entities or segments can be that large, and a round makes at
most ``(FINER + 1) * MAX_SHARE`` segments of them. These lookups are
bounded whatever the data size, which is why they may pass through the driver
and be broadcast. Where no entity is that large, the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

MAX_SHARE = 10_000
# Segments per share of rows, so that most fit although they are not quite even.
FINER = 2
MIN_ROWS = 1_000_000
SEGMENT = "segment"


@dataclass(frozen=True)
class Segmented:
    """Rows with a ``segment`` column, and the large keys that have more than one."""

    rows: DataFrame
    large_rows: DataFrame
    keys: tuple[str, ...]
    order: str
    ties: tuple[str, ...] = ()

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SEGMENT).orderBy(self.order, *self.ties)

    @property
    def place(self) -> Column:
        """What rows of a segment are ordered by, as one value."""
        return F.struct(self.order, *self.ties)

    @property
    def over_segments(self) -> WindowSpec:
        """Window over the segment summaries of one key: bounded, see above."""
        return Window.partitionBy(*self.keys).orderBy(SEGMENT)

    def attach(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        """Add a summary's columns to the rows; null for keys that were not cut."""
        return rows.join(F.broadcast(carried), [*self.keys, SEGMENT], "left")


def _large_keys(
    df: DataFrame, keys: tuple[str, ...], order: str, min_rows: int, max_share: int
) -> tuple[list[Row], int]:
    """Keys with more than ``max(min_rows, all rows / max_share)`` rows, and that limit.

    One narrow pass, combined before the shuffle: the grand total comes from the
    same aggregate and, being the largest count, first.
    """
    sizes = df.rollup(*keys).agg(F.grouping_id().alias("level"), *_size(order))
    whole = (1 << len(keys)) - 1
    candidates = sizes.where(
        (F.col("level") == whole) | ((F.col("level") == 0) & (F.col("n") > min_rows))
    ).orderBy(F.desc("n"), F.desc("level"))
    # Any key beyond these holds less than its share.
    found = candidates.limit(max_share + 1).collect()
    if not found:
        return [], min_rows
    limit = max(min_rows, found[0]["n"] // max_share)
    return [row for row in found[1:] if row["n"] > limit], limit


def _size(order: str) -> list[Column]:
    return [F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")]


def _cut(rows: DataFrame, ranges: DataFrame, keys: tuple[str, ...], order: str, how: str) -> DataFrame:
    """Next round of segment numbers: even parts of the given ranges, others whole."""
    lowest = F.expr(f"low + ({order} - low) div width * width")
    return (
        rows.join(F.broadcast(ranges), [*keys, SEGMENT], how)
        .withColumn(SEGMENT, F.coalesce(lowest, SEGMENT))
        .drop("low", "width")
    )


def split(
    df: DataFrame,
    keys: tuple[str, ...],
    order: str,
    min_rows: int = MIN_ROWS,
    max_share: int = MAX_SHARE,
    ties: tuple[str, ...] = (),
) -> Segmented:
    """Cut the large keys of ``df`` along ``order``, an integer column.

    Equal values of ``order`` stay in one segment, where ``ties`` order them.
    """
    spark = df.sparkSession
    rows = df.withColumn(SEGMENT, F.lit(0).cast("long"))
    large, limit = _large_keys(df, keys, order, min_rows, max_share)
    if not large:
        return Segmented(rows, rows.where(F.lit(False)), keys, order, ties)

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = spark.createDataFrame([tuple(row[k] for k in keys) for row in large], types)
    dense = [row.asDict() | {SEGMENT: 0} for row in large]
    while dense:
        ranges = spark.createDataFrame(
            [
                (*(d[k] for k in keys), d[SEGMENT], d["low"], (d["high"] - d["low"]) // -(-FINER * d["n"] // limit) + 1)
                for d in dense
            ],
            f"{types}, {SEGMENT} long, low long, width long",
        )
        counted = _cut(rows, ranges, keys, order, "inner").groupBy(*keys, SEGMENT).agg(*_size(order))
        rows = _cut(rows, ranges, keys, order, "left")
        # As many as there are shares at most; a single value cannot be cut.
        crowded = counted.where((F.col("n") > limit) & (F.col("high") > F.col("low")))
        dense = [row.asDict() for row in crowded.collect()]
    return Segmented(rows, rows.join(F.broadcast(names), list(keys)), keys, order, ties)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def up_to(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
