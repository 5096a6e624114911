"""Derived values: on matches, moved to player timelines, and counted per player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .classify import real_match_status


def with_derived(matches: DataFrame, **derived: Column) -> DataFrame:
    """Matches with a ``derived`` map of the given values; nulls make no entry."""
    entries = F.array(
        *(
            F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))
            for name, value in derived.items()
        )
    )
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return matches.withColumn("derived", F.map_from_entries(present))


def transfer(matches: DataFrame, pattern: str = ".*") -> DataFrame:
    """Copy each match's derived values to its players' timelines, at match time.

    ``pattern`` selects qualifiers by full match. Anonymous players are skipped.
    Puts at one (account, qualifier, ts) collapse: first inside the match,
    without a shuffle, then over matches, where the highest match id stays.
    """
    known = F.filter(F.transform("players", lambda p: p["account_id"]), values.non_anonymous)
    wanted = F.map_filter("derived", lambda q, _: q.rlike(f"^(?:{pattern})$"))
    # Reduce each match row before it is multiplied by its players and values.
    per_match = matches.select(
        "match_id",
        F.col("start_ms").alias("ts"),
        wanted.alias("wanted"),
        F.array_distinct(known).alias("accounts"),
    )
    puts = per_match.select(
        "match_id", "ts", F.explode("accounts").alias("account_id"), "wanted"
    ).select(
        F.col("account_id").cast("long").alias("account_id"),
        "ts",
        "match_id",
        F.explode("wanted").alias("qualifier", "value"),
    )
    return puts.groupBy("account_id", "qualifier", "ts").agg(
        F.max_by("value", "match_id").alias("value")
    )


def player_timeline(matches: DataFrame, versions: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-anonymous player and game, with the match's status beside it.

    The status and the win flag come from the match row itself, so the timeline
    needs no join. ``versions`` names player fields that hold the seat's own
    version; otherwise the version ``ts`` is the match start.
    """
    p = F.col("player")
    stamps = [p[v].alias(v) for v in versions] or [F.col("start_ms").alias("ts")]

    def slim(q: Column) -> Column:
        return F.struct(*(q[f] for f in ("account_id", "hero_id", "player_slot", *versions)))

    # The status is settled once per match, before the players are exploded.
    per_match = matches.select(
        "match_id",
        "start_ms",
        "radiant_win",
        real_match_status().alias("real_match"),
        F.transform(
            F.filter("players", lambda q: values.non_anonymous(q["account_id"])), slim
        ).alias("known"),
    )
    return per_match.select(
        "match_id", "start_ms", "radiant_win", "real_match", F.explode("known").alias("player")
    ).select(
        p["account_id"].cast("long").alias("account_id"),
        *stamps,
        "match_id",
        p["hero_id"].alias("hero_id"),
        p["player_slot"].alias("player_slot"),
        "radiant_win",
        values.won(p["player_slot"], F.col("radiant_win")).alias("win"),
        "real_match",
    )


def games_played(timeline: DataFrame, ts: int = 0) -> DataFrame:
    """Per player with any classified game: how many were not abandoned."""
    return (
        timeline.where(F.col("real_match").isNotNull())
        .groupBy("account_id")
        .agg(F.count_if(F.col("real_match") != 1.0).cast("double").alias("games_played"))
        .select("account_id", F.lit(ts).cast("long").alias("ts"), "games_played")
    )
