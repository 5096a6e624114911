"""What players pick: counts, shares, row numbers and one vector per hero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import cells

# Ids are at most 64 bits wide and numbered in blocks of 2^16 ids.
_ID_BITS = 64
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS


def classified_games(timeline: DataFrame) -> DataFrame:
    """Games in matches with any status."""
    return timeline.where(F.col("real_match").isNotNull())


def _earlier_players(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, earlier) for (block, players): the players of all lower blocks of ``bits`` bits.

    Counts of earlier blocks are summed within groups of 2^16 blocks, and the groups' own
    counts in the same way, so that no task sums over more than 65,536 of them
    and groups are summed side by side.
    """
    lower = lambda window: F.coalesce(
        F.sum("players").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    if bits <= _BLOCK_BITS:
        return blocks.select("block", lower(Window.orderBy("block")).alias("earlier"))
    grouped = blocks.withColumn("above", F.shiftright("block", _BLOCK_BITS))
    inside = grouped.withColumn("inside", lower(Window.partitionBy("above").orderBy("block")))
    sums = grouped.groupBy(F.col("above").alias("block")).agg(F.sum("players").alias("players"))
    above = _earlier_players(sums, bits - _BLOCK_BITS).select(F.col("block").alias("above"), "earlier")
    return inside.join(above, "above").select("block", (F.col("inside") + F.col("earlier")).alias("earlier"))


def player_row_numbers(timeline: DataFrame, size_filter: int) -> DataFrame:
    """Dense numbers from 0, by account id, of players with enough classified games.

    Numbers are local to a block of ids plus the count of earlier blocks, see
    :func:`_earlier_players`. Ids may be of any integer type; negative ones come first, and
    games without an id, as one player, before them.
    """
    players = (
        classified_games(timeline)
        .groupBy("account_id")
        .agg(F.count("*").alias("games"))
        .where(F.col("games") >= size_filter)
        # Never null, so that both uses below keep the same plan and share its shuffle.
        .select(
            "account_id",
            F.coalesce(
                F.shiftright(F.col("account_id").cast("long"), _BLOCK_BITS),
                F.lit(-1 << (_ID_BITS - _BLOCK_BITS - 1)),
            ).alias("block"),
        )
    )
    blocks = players.groupBy("block").agg(F.count("*").alias("players"))
    inside = Window.partitionBy("block").orderBy("account_id")
    return (
        players.withColumn("local", F.row_number().over(inside) - 1)
        .join(_earlier_players(blocks, _ID_BITS - _BLOCK_BITS), "block")
        .select("account_id", (F.col("earlier") + F.col("local")).cast("double").alias("row_number"))
    )


def row_number_cells(numbers: DataFrame, size_filter: int, ts: int = 0) -> DataFrame:
    """Row numbers as cells; the size filter is part of the qualifier."""
    stamped = numbers.withColumn("ts", F.lit(ts))
    return cells.from_columns(
        stamped, "account_id", "ts", **{f"row_number_{size_filter}": "row_number"}
    )


def hero_counts(timeline: DataFrame) -> DataFrame:
    """Classified games per (player, hero)."""
    return (
        classified_games(timeline)
        .groupBy("account_id", "hero_id")
        .agg(F.count("*").alias("games"))
    )


def pick_triples(timeline: DataFrame, size_filter: int) -> DataFrame:
    """(index, vec, val, size) of games per hero, for players with more than
    ``size_filter`` classified games."""
    # One row per hero a player picked, so the window is bounded by the heroes.
    per_player = Window.partitionBy("account_id")
    counts = hero_counts(timeline).withColumn("size", F.sum("games").over(per_player))
    return counts.where(F.col("size") > size_filter).select(
        F.col("account_id").alias("index"),
        F.col("hero_id").alias("vec"),
        F.col("games").cast("double").alias("val"),
        "size",
    )


def hero_pick_share(timeline: DataFrame, row_numbers: DataFrame) -> DataFrame:
    """Share of a player's classified games on each hero, for numbered players."""
    per_player = Window.partitionBy("account_id")
    counts = hero_counts(timeline).withColumn("total", F.sum("games").over(per_player))
    return counts.join(row_numbers, "account_id").select(
        F.col("row_number").cast("long").alias("player_row"),
        "hero_id",
        (F.col("games") / F.col("total")).alias("share"),
    )


def pick_vectors(shares: DataFrame, block_rows: int = _BLOCK) -> DataFrame:
    """One sparse vector per hero, stored as blocks of consecutive player rows.

    A vector is as long as there are players, so a block of it, not the whole,
    is one value: two arrays of at most ``block_rows`` entries, sorted by row.
    """
    entry = F.struct("player_row", "share")
    return (
        shares.groupBy("hero_id", F.expr(f"player_row div {block_rows}").alias("block"))
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            "hero_id",
            "block",
            F.transform("entries", lambda e: e["player_row"]).alias("indices"),
            F.transform("entries", lambda e: e["share"]).alias("values"),
        )
    )
