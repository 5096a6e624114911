"""How well each player does on each hero, raw or against the hero's win rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.slots import slot_start
from ..sources.dimensions import MAX_LOOKUP_BYTES, settle

# Rows of a group that ranking keeps on the map side at most, and parts of larger groups.
_RANKED, _PARTS = 1000, 64
# Parts of a hero's games in a slot, where the rates are too many to broadcast.
_SALTS = 16


def _signed_games(timeline: DataFrame, drop_first: int, order: str, *columns: str) -> DataFrame:
    """Real games with sign 1, and each player's first games again with sign -1.

    Sums of signed games leave the first ones out without ordering the whole timeline:
    ranking keeps only the first ``drop_first`` rows per player on the map side, and both
    parts are summed before the shuffle, so a player with very many games costs
    no more than others.
    """
    keys = ["account_id", "hero_id", *columns, "win"]
    real = timeline.where(F.col("real_match") >= fixed.REAL_MATCH)
    signed = real.select(*keys, F.lit(1).alias("sign"))
    if drop_first <= 0:
        return signed
    games = real.select(*keys, F.col(order).alias("at"))
    oldest = Window.partitionBy("account_id").orderBy("at")
    if drop_first > _RANKED:
        # More games than the map side ranks: a part of a player's games goes to each
        # of several tasks, which pass on their oldest ones only.
        part = F.pmod(F.xxhash64("at"), F.lit(_PARTS))
        within = Window.partitionBy("account_id", "part").orderBy("at")
        games = games.withColumn("part", part).withColumn("n", F.row_number().over(within))
        games = games.where(F.col("n") <= drop_first).drop("part", "n")
    first = games.withColumn("n", F.row_number().over(oldest)).where(F.col("n") <= drop_first)
    return signed.unionByName(first.select(*keys, F.lit(-1).alias("sign")))


def hero_skill_raw(
    timeline: DataFrame, drop_first: int, min_games: int, order: str = "ts"
) -> DataFrame:
    """Mean win and number of games per (player, hero)."""
    games = (
        _signed_games(timeline, drop_first, order)
        .groupBy("account_id", "hero_id")
        .agg(F.sum("sign").alias("games"), F.sum(F.when(F.col("win"), F.col("sign")).otherwise(0)).alias("wins"))
        .where(F.col("games") > 0)
    )
    return games.where(F.col("games") >= min_games).select(
        "account_id",
        "hero_id",
        (F.col("wins") / F.col("games")).alias("score"),
        F.col("games").alias("size"),
    )


def hero_skill_adjusted(
    timeline: DataFrame,
    rates: DataFrame,
    interval: int,
    drop_first: int,
    min_games: int,
    order: str = "ts",
    time_ms: str = "ts",
    max_bytes: int = MAX_LOOKUP_BYTES,
) -> DataFrame:
    """Mean of win minus the hero's win rate in the game's slot, per (player, hero).

    ``rates`` has (hero_id, slot_ms, win_rate) with slots of ``interval`` seconds.
    Games in slots without a rate do not count in the mean, but do count
    towards ``min_games``.

    Rates are written once, and their size decides the join: up to ``max_bytes`` they are broadcast;
    beyond, a copy of them meets each of 16 parts of the players, as a popular hero's
    games in one slot would be too many for a task.
    """
    slotted = timeline.withColumn("slot_ms", slot_start(F.col(time_ms), interval))
    # Heroes times slots: mostly small beside the games, which then meet the rates where they are read.
    expected, size = settle(rates.select("hero_id", "slot_ms", "win_rate"))
    games = _signed_games(slotted, drop_first, order, "slot_ms")
    if size <= max_bytes:
        games = games.join(F.broadcast(expected), ["hero_id", "slot_ms"], "left")
    else:
        games = games.withColumn("salt", F.pmod(F.xxhash64("account_id"), F.lit(_SALTS)))
        copies = expected.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        games = games.join(copies, ["hero_id", "slot_ms", "salt"], "left")
    rated = F.when(F.col("win_rate").isNotNull(), F.col("sign"))
    return (
        games.groupBy("account_id", "hero_id")
        .agg(
            F.sum("sign").alias("games"),
            F.sum(rated).alias("size"),
            F.sum(F.when(F.col("win"), rated)).alias("wins"),
            F.sum(rated * F.col("win_rate")).alias("expected"),
        )
        .where((F.col("games") >= max(min_games, 1)) & (F.col("size") > 0))
        .select(
            "account_id",
            "hero_id",
            ((F.coalesce("wins", F.lit(0)) - F.col("expected")) / F.col("size")).alias("score"),
            "size",
        )
    )


def as_triples(skill: DataFrame) -> DataFrame:
    """(index, vec, val, size): players as indexes, heroes as vectors."""
    return skill.select(
        F.col("account_id").alias("index"),
        F.col("hero_id").alias("vec"),
        F.col("score").alias("val"),
        "size",
    )
