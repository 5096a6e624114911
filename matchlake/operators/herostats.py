"""Hero win rates per time slot, raw and smoothed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.slots import slot_start
from ..sources import cells
from .classify import real_match_status


def hero_win_rates(matches: DataFrame, interval: int, min_status: float = 1.0) -> DataFrame:
    """Games and win rate per (hero, slot), over all players of classified matches.

    By default every classified match counts, abandoned ones too.
    """
    p = F.col("p")
    per_match = matches.select(
        slot_start(F.col("start_ms"), interval).alias("slot_ms"),
        "radiant_win",
        real_match_status().alias("status"),
        F.transform("players", lambda q: F.struct(q["hero_id"], q["player_slot"])).alias("seats"),
    ).where(F.col("status") >= min_status)
    return (
        per_match.select("slot_ms", "radiant_win", F.explode("seats").alias("p"))
        .groupBy(p["hero_id"].alias("hero_id"), "slot_ms")
        .agg(
            F.count("*").cast("double").alias("games_played"),
            F.avg(values.won(p["player_slot"], F.col("radiant_win")).cast("int")).alias("win_rate"),
        )
    )


def _cells(rates: DataFrame, suffix: str) -> DataFrame:
    qualifiers = {f"games_played_{suffix}": "games_played", f"win_rate_{suffix}": "win_rate"}
    return cells.from_columns(rates, "hero_id", "slot_ms", **qualifiers)


def hero_cells(rates: DataFrame, interval: int) -> DataFrame:
    """Hero statistics as versioned cells; the interval is part of the qualifier."""
    return _cells(rates, str(interval))


def sliding_cells(rates: DataFrame, start_interval: int, window_step: int) -> DataFrame:
    """Smoothed statistics as versioned cells, named after the distance of their slots."""
    return _cells(rates, f"average_{start_interval * window_step}")


def sliding_hero_win_rates(
    rates: DataFrame, start_interval: int, window_size: int, window_step: int, min_games: float
) -> DataFrame:
    """Games-weighted win rate over a window that grows until it holds enough games.

    Each hero's slots are filled up to an even grid. Around every
    ``window_step``-th slot the window grows by one slot at each end, staying on
    the grid, until it is ``window_size`` wide and has ``min_games`` games. Slots
    that never get there are left out.

    Both width and games only grow with the radius, so the smallest radius is
    found by bisection over prefix sums. A hero's arrays are bounded by the number
    of slots in the covered time, whatever the number of matches.
    """
    if window_size % 2 == 0:
        raise ValueError("window_size must be odd")
    step_ms = start_interval * 1000
    grid_ms = step_ms * window_step

    spans = rates.groupBy("hero_id").agg(
        F.min("slot_ms").alias("first_ms"), F.max("slot_ms").alias("last_ms")
    )
    start = F.col("first_ms") - F.pmod("first_ms", F.lit(grid_ms))
    grid = spans.select(
        "hero_id", F.posexplode(F.sequence(start, "last_ms", F.lit(step_ms))).alias("pos", "slot_ms")
    )
    filled = grid.join(rates, ["hero_id", "slot_ms"], "left").select(
        "hero_id",
        "pos",
        "slot_ms",
        F.coalesce("games_played", F.lit(0.0)).alias("games"),
        F.coalesce(F.col("games_played") * F.col("win_rate"), F.lit(0.0)).alias("wins"),
    )
    through = Window.partitionBy("hero_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        filled.withColumn("games_through", F.sum("games").over(through))
        .withColumn("wins_through", F.sum("wins").over(through))
        .groupBy("hero_id")
        .agg(
            F.min("slot_ms").alias("grid_start"),
            F.sort_array(F.collect_list(F.struct("pos", "games_through", "wins_through"))).alias("s"),
        )
        .select(
            "hero_id",
            "grid_start",
            F.size("s").alias("n"),
            F.transform("s", lambda x: x["games_through"]).alias("g"),
            F.transform("s", lambda x: x["wins_through"]).alias("w"),
        )
    )

    n = F.col("n")

    def low(i: Column, r: Column) -> Column:
        return F.greatest(i - r, F.lit(0))

    def high(i: Column, r: Column) -> Column:
        return F.least(i + r, n - 1)

    def total(prefix: str, i: Column, r: Column) -> Column:
        below = F.coalesce(F.get(prefix, low(i, r) - 1), F.lit(0.0))
        return F.get(prefix, high(i, r)) - below

    def enough(i: Column, r: Column) -> Column:
        wide = high(i, r) - low(i, r) + 1 >= window_size
        return wide & (total("g", i, r) >= min_games)

    def halve(i: Column, bounds: Column) -> Column:
        middle = F.shiftright(bounds["lo"] + bounds["hi"], 1)
        good = enough(i, middle)
        return F.when(
            bounds["lo"] < bounds["hi"],
            F.struct(
                F.when(good, bounds["lo"]).otherwise(middle + 1).alias("lo"),
                F.when(good, middle).otherwise(bounds["hi"]).alias("hi"),
            ),
        ).otherwise(bounds)

    def radius(i: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
        return F.aggregate(rounds, start, lambda b, _: halve(i, b), lambda b: b["lo"])

    centres = F.transform(
        F.sequence(F.lit(0), n - 1, F.lit(window_step)),
        lambda i: F.struct(i.alias("i"), radius(i).alias("r")),
    )
    # A radius of n means that the whole grid was not enough.
    reached = F.filter(centres, lambda c: c["r"] < n)
    windows = F.transform(
        reached,
        lambda c: F.struct(
            c["i"].alias("i"),
            total("g", c["i"], c["r"]).alias("games_played"),
            total("w", c["i"], c["r"]).alias("wins"),
        ),
    )
    return (
        sums.select("hero_id", "grid_start", F.inline(windows))
        .select(
            "hero_id",
            (F.col("grid_start") + F.col("i").cast("long") * step_ms).alias("slot_ms"),
            "games_played",
            F.try_divide("wins", "games_played").alias("win_rate"),
        )
    )
