"""Counts of values over time, and of what the winners kept."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import values
from ..functions.slots import date_label, slot_end, slot_start
from .classify import real_match_status

WEEK_SECONDS = 7 * 24 * 60 * 60


def winner_rax_counts(matches: DataFrame) -> DataFrame:
    """Real matches by the number of barracks the winner still has."""
    left = values.winner_barracks(
        F.col("radiant_win"), F.col("radiant_barracks_status"), F.col("dire_barracks_status")
    )
    return (
        matches.where(real_match_status() >= fixed.REAL_MATCH)
        .groupBy(left.cast("int").alias("raxes_left"))
        .agg(F.count("*").alias("games_won"))
    )


def winner_rax_percent(counts: DataFrame) -> DataFrame:
    """The counts with their share of the total, and a total row with a null key."""
    # At most one row per number of set bits in a barracks status.
    everything = Window.partitionBy()
    totals = counts.rollup("raxes_left").agg(F.sum("games_won").alias("games_won"))
    total = F.max("games_won").over(everything)
    return totals.withColumn("percent", F.col("games_won") / total)


def histogram(matches: DataFrame, column: str, interval: int) -> DataFrame:
    """Counts per (value, slot) of one column; slots are ``start-end`` texts."""
    start = slot_start(F.col("start_ms"), interval)
    end = slot_end(F.col("start_ms"), interval)
    return (
        matches.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"), F.concat_ws("-", start, end).alias("slot"))
        .agg(F.count("*").alias("count"))
    )


def multi_histogram(matches: DataFrame, columns: list[str], interval: int) -> DataFrame:
    """Counts per (field, value, slot) of several columns in one pass.

    Matches that lack any of the columns do not count.
    """
    cells = F.array(
        *(
            F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
            for c in columns
        )
    )
    complete = matches.dropna(subset=columns)
    return (
        complete.select(
            slot_start(F.col("start_ms"), interval).alias("start"),
            slot_end(F.col("start_ms"), interval).alias("end"),
            F.inline(cells),
        )
        .groupBy("field", "value", "start", "end")
        .agg(F.count("*").alias("count"))
    )


def value_key(family: str, column: str, interval: int | None = None) -> Column:
    """Key text ``family:column=value [start-end)``; a missing value is ``NULL``."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
    parts = [F.lit(f"{family}:{column}="), value]
    if interval is not None:
        start = slot_start(F.col("start_ms"), interval).cast("string")
        end = slot_end(F.col("start_ms"), interval).cast("string")
        parts += [F.lit(" ["), start, F.lit("-"), end, F.lit(")")]
    return F.concat(*parts)


def key_histogram(matches: DataFrame, *keys: Column) -> DataFrame:
    """Counts per key, over any number of key expressions such as :func:`value_key`."""
    return (
        matches.select(F.explode(F.array(*keys)).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("count"))
    )


def _label(field: Column, value: Column) -> Column:
    code = value.try_cast("int")
    return F.coalesce(
        F.when(field == "game_mode", values.game_mode_label(code)),
        F.when(field == "lobby_type", values.lobby_type_name(code)),
        value,
    )


def weekly_histogram(counts: DataFrame) -> DataFrame:
    """Counts of :func:`multi_histogram` in weekly bins from each field's first slot.

    Bins start before the field's last slot, so a slot exactly on the last edge
    is lost. Every value has every bin. Slots starting at 0 are faults of the
    feed and do not count.
    """
    dated = counts.where(F.col("start") != 0).withColumn("seconds", F.expr("start div 1000"))
    # One row per histogram column, which the caller listed.
    edges = F.broadcast(
        dated.groupBy("field").agg(F.min("seconds").alias("first"), F.max("seconds").alias("last"))
    )
    week = F.lit(WEEK_SECONDS)
    binned = (
        dated.join(edges, "field")
        .groupBy("field", "value", F.expr(f"(seconds - first) div {WEEK_SECONDS}").alias("bin"))
        .agg(F.sum("count").alias("count"))
    )
    bins = F.ceil((F.col("last") - F.col("first")) / week)
    grid = (
        dated.select("field", "value")
        .distinct()
        .join(edges, "field")
        .where(bins > 0)
        .select(
            "field",
            "value",
            "first",
            F.explode(F.sequence(F.lit(0).cast("long"), bins - 1)).alias("bin"),
        )
    )
    start_ms = (F.col("first") + F.col("bin") * week) * 1000
    return grid.join(binned, ["field", "value", "bin"], "left").select(
        "field",
        _label(F.col("field"), F.col("value")).alias("value"),
        start_ms.alias("bin_ms"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def weekly_histogram_wide(weekly: DataFrame, field: str) -> DataFrame:
    """One field's weekly counts: a row per value, a column per bin date."""
    one = weekly.where(F.col("field") == field)
    # The columns of the result: one per week between the first and the last.
    first, last = one.agg(F.min("bin_ms"), F.max("bin_ms")).first()
    starts = [] if first is None else range(first, last + 1, WEEK_SECONDS * 1000)
    dates = [datetime.fromtimestamp(s / 1000, UTC).strftime("%m-%d-%Y") for s in starts]
    dated = one.withColumn("date", date_label(F.col("bin_ms")))
    return dated.groupBy("value").pivot("date", dates).agg(F.sum("count"))


def unpivot_weeks(wide: DataFrame) -> DataFrame:
    """The wide form as (value, date, count)."""
    dates = [c for c in wide.columns if c != "value"]
    return wide.unpivot("value", dates, "date", "count")
