"""Match classification: did everybody stay, leave safely, or abandon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import values


def _serious() -> Column:
    return (
        values.serious_game(F.col("game_mode"))
        & values.serious_lobby(F.col("lobby_type"))
        & (F.col("human_players") == fixed.FULL_MATCH_PLAYERS)
    )


def _someone_abandoned() -> Column:
    # A missing status is a bot, which counts as an abandon.
    return F.exists("players", lambda p: F.coalesce(p["leaver_status"], F.lit(2)) >= 2)


def _someone_left_safely() -> Column:
    return F.exists("players", lambda p: F.coalesce(p["leaver_status"] == 1, F.lit(False)))


def real_match_status() -> Column:
    """3 all stayed, 2 someone left safely, 1 someone abandoned; null for non-serious matches."""
    status = (
        F.when(_someone_abandoned(), fixed.ABANDONED)
        .when(_someone_left_safely(), fixed.SAFE_LEAVE)
        .otherwise(fixed.ALL_STAYED)
    )
    return F.when(_serious(), status)


def real_matches(matches: DataFrame, ts: int = 0) -> DataFrame:
    """Status of every serious match, as a cell written at version ``ts``."""
    return (
        matches.select(
            "match_id", F.lit(ts).cast("long").alias("ts"), real_match_status().alias("real_match")
        )
        .where(F.col("real_match").isNotNull())
    )


def real_match_counters(matches: DataFrame) -> DataFrame:
    """Nine quality counters of the classification, in one pass."""
    facts = matches.select(
        values.serious_game(F.col("game_mode")).alias("good_mode"),
        values.serious_lobby(F.col("lobby_type")).alias("good_lobby"),
        (F.col("human_players") == fixed.FULL_MATCH_PLAYERS).alias("full"),
        _serious().alias("serious"),
        _someone_abandoned().alias("leavers"),
        _someone_left_safely().alias("safe"),
    )
    serious, leavers = F.col("serious"), F.col("leavers")
    safe_only = F.col("safe") & ~leavers
    return facts.agg(
        F.count_if(serious).alias("good_matches"),
        F.count_if(~F.col("good_mode")).alias("bad_game_mode"),
        F.count_if(~F.col("good_lobby")).alias("bad_lobby"),
        F.count_if(leavers).alias("leavers"),
        F.count_if(safe_only).alias("safe_leavers"),
        F.count_if(leavers & serious).alias("real_match_with_leavers"),
        F.count_if(safe_only & serious).alias("real_match_with_safe_leavers"),
        F.count_if(~serious).alias("bad_matches"),
        F.count_if(~F.col("full")).alias("under_ten_players"),
    )
