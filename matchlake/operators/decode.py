"""Raw codes of matches and players as names, flags and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..sources.dimensions import lookup


def decode_matches(matches: DataFrame) -> DataFrame:
    """Game mode and lobby names, and tower and barracks flags and counts per side."""
    sides = []
    for side in ("dire", "radiant"):
        towers = F.col(f"{side}_towers_status")
        barracks = F.col(f"{side}_barracks_status")
        sides += [
            F.struct(*values.tower_flags(towers)).alias(f"{side}_towers"),
            values.towers_standing(towers).alias(f"{side}_towers_standing"),
            F.struct(*values.barracks_flags(barracks)).alias(f"{side}_barracks"),
            values.barracks_standing(barracks).alias(f"{side}_barracks_standing"),
        ]
    return matches.select(
        "match_id",
        values.game_mode_name(F.col("game_mode")).alias("game_mode_name"),
        values.lobby_type_name(F.col("lobby_type")).alias("lobby_type_name"),
        values.serious_game(F.col("game_mode")).alias("serious_game"),
        values.serious_lobby(F.col("lobby_type")).alias("serious_lobby"),
        *sides,
    )


def decode_players(matches: DataFrame, heroes: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item slot of a player: slot, side, status, hero and item names."""
    heroes = lookup(heroes.withColumnRenamed("name", "hero_name"))
    items = lookup(items.withColumnRenamed("name", "item_name"))
    p = F.col("p")
    return (
        matches.select("match_id", F.explode("players").alias("p"))
        .select(
            "match_id",
            p["player_slot"].alias("player_slot"),
            values.team_slot(p["player_slot"]).alias("team_slot"),
            values.is_radiant(p["player_slot"]).alias("radiant"),
            values.non_anonymous(p["account_id"]).alias("known_account"),
            values.leaver_status_name(p["leaver_status"]).alias("leaver_status_name"),
            p["hero_id"].alias("hero_id"),
            F.posexplode(p["item_ids"]).alias("position", "item_id"),
        )
        .join(heroes, "hero_id", "left")
        .join(items, "item_id", "left")
        .withColumn("item_slot", values.item_slot_name(F.col("position")))
    )
