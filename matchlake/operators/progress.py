"""Streaks and game counts kept up to date: a state per player, advanced by each batch of games.

The state of a player is what later games need: the last game's place, the number of all,
real and classified games, and the streak that the next real game is entered with. A
batch is ordered among itself and joined to the states of its own players, so its cost follows
the batch and not the history. A player with games before the last one known is
replayed from the history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .timeline import PLAYER, signed_streaks

STATE = (
    "account_id BIGINT, last_order BIGINT, last_match BIGINT, games BIGINT, real_games BIGINT, streak INT,"
    " classified BIGINT, not_abandoned BIGINT"
)


#: Writes a table that several later steps read, by its name, and reads it again.
Keep = Callable[[DataFrame, str], DataFrame]


def no_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


@dataclass(frozen=True)
class Advanced:
    """Rows of a batch and the state after it.

    ``rows`` has (account_id, ``order``, match_id, win, game_no, real_no, streak) of each real game; those
    of ``replayed`` players (account_id) are all of their rows and take the place of earlier ones.
    """

    rows: DataFrame
    replayed: DataFrame
    state: DataFrame


def _place(prefix: str, order: str, match: str) -> Column:
    return F.struct(F.col(f"{prefix}{order}").cast("bigint").alias("at"), F.col(f"{prefix}{match}").cast("bigint").alias("match"))


def _after(streak: Column, win: Column) -> Column:
    """The streak after a game that was entered with ``streak``."""
    return F.when(win, F.greatest(streak, F.lit(0)) + 1).otherwise(F.least(streak, F.lit(0)) - 1)


def _summary(games: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """State columns over these games alone, the streak being that of ``rows``."""
    counts = games.select(
        *PLAYER, _place("", order, "match_id").alias("place"), F.lit(1).alias("game"),
        F.coalesce(F.col("real_match") >= fixed.REAL_MATCH, F.lit(False)).cast("int").alias("real"),
        F.col("real_match").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("real_match") != fixed.ABANDONED, F.lit(False)).cast("int").alias("stayed"),
    )
    streaks = rows.select(*PLAYER, _place("", order, "match_id").alias("real_place"), _after(F.col("streak"), F.col("win")).alias("after"))
    # One shuffle for both: sums are combined before it, so a player with many games costs no more.
    both = counts.unionByName(streaks, allowMissingColumns=True)
    whole = both.groupBy(*PLAYER).agg(
        F.max("place").alias("place"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in (("games", "game"), ("real_games", "real"), ("classified", "known"), ("not_abandoned", "stayed"))],
        F.coalesce(F.max_by("after", "real_place"), F.lit(0)).cast("int").alias("streak"),
    )
    return whole.select(
        *PLAYER, F.col("place.at").alias("last_order"), F.col("place.match").alias("last_match"),
        "games", "real_games", "streak", "classified", "not_abandoned",
    )


def advance(
    state: DataFrame, games: DataFrame, history: DataFrame, order: str = "ts", keep: Keep = lambda table, _: table, **sizes: int
) -> Advanced:
    """The next batch of games: its rows and the state after it.

    ``games`` has (account_id, ``order``, match_id, win, real_match), ``history`` the same of all games up to and
    with this batch; only players with late games are read from it. Games of a batch may come
    in any order. Null accounts have no state and are left out; an empty batch changes nothing. A repeated
    game counts again, as it does over the whole history. With ``keep`` each step is worked out once: the
    replayed players, the batch with their games, its rows and the state.
    """
    known = games.where(F.col("account_id").isNotNull())
    last = state.select(*PLAYER, _place("", "last_order", "last_match").alias("last"))
    early = known.groupBy(*PLAYER).agg(F.min(_place("", order, "match_id")).alias("first"))
    replayed = keep(early.join(last, list(PLAYER)).where(F.col("first") <= F.col("last")).select(*PLAYER), "replayed")

    fresh = known.join(replayed, list(PLAYER), "left_anti")
    again = history.join(replayed, list(PLAYER), "left_semi")
    columns = [*PLAYER, order, "match_id", "win", "real_match"]
    batch = keep(fresh.select(*columns).unionByName(again.select(*columns)), "batch")
    local = signed_streaks(batch, order, **sizes)

    # A replayed player starts anew; others go on from their state.
    carried = state.join(replayed, list(PLAYER), "left_anti")
    before = carried.select(*PLAYER, F.col("games").alias("games_before"), F.col("real_games").alias("real_before"), F.col("streak").alias("entered"))
    joined = local.join(before, list(PLAYER), "left")
    nothing = F.lit(0)
    entered = F.coalesce("entered", nothing)
    # Games before the batch's first change of result continue the run that came before.
    unchanged = F.abs("streak") == F.col("real_no") - 1
    same = (F.col("real_no") == 1) | (F.signum("streak") == F.signum(entered))
    rows = joined.select(
        *PLAYER, order, "match_id", "win",
        (F.coalesce("games_before", nothing) + F.col("game_no")).alias("game_no"),
        (F.coalesce("real_before", nothing) + F.col("real_no")).alias("real_no"),
        F.when(unchanged & same, F.col("streak") + entered).otherwise(F.col("streak")).cast("int").alias("streak"),
    )
    rows = keep(rows, "rows")

    seen = _summary(batch, rows, order).withColumn("fresh", F.lit(True))
    merged = carried.withColumn("fresh", F.lit(False)).unionByName(seen)
    newest = F.max(F.struct("last_order", "last_match"))
    # The batch's streak counts from the state already; without real games in it the state's stays.
    moved = F.max_by("streak", F.when(~F.col("fresh") | (F.col("real_games") > 0), F.col("fresh")))
    total = merged.groupBy(*PLAYER).agg(
        newest.alias("newest"), moved.alias("streak"),
        *[F.sum(c).alias(c) for c in ("games", "real_games", "classified", "not_abandoned")],
    )
    following = total.select(
        *PLAYER, F.col("newest.last_order").alias("last_order"), F.col("newest.last_match").alias("last_match"),
        "games", "real_games", F.coalesce("streak", nothing).cast("int").alias("streak"), "classified", "not_abandoned",
    )
    return Advanced(rows, replayed, keep(following, "state"))


def games_played(state: DataFrame, ts: int = 0) -> DataFrame:
    """As :func:`.derive.games_played`, from the state."""
    played = F.col("not_abandoned").cast("double").alias("games_played")
    return state.where(F.col("classified") > 0).select(*PLAYER, F.lit(ts).cast("long").alias("ts"), played)


def advance_tables(
    spark: SparkSession, folder: str, number: int, games: DataFrame, history: DataFrame, order: str = "ts", **sizes: int
) -> None:
    """Batch ``number`` (from 0) of a chain of tables under ``folder``, which all executors share.

    Each batch writes its games, rows, replayed players and state beside those before it and changes nothing, so a
    batch that was broken off is written again. ``games`` is read twice and ``history`` once, so they should be tables.
    """
    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/{name}-{number}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}-{number}")

    state = spark.read.schema(STATE).parquet(f"{folder}/state-{number - 1}") if number else no_state(spark)
    advance(state, games, history, order, keep, **sizes)


def current_rows(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Rows of batches 0 to ``number``, replayed players from their last replay on."""
    rows = replays = None
    for k in range(number + 1):
        own = spark.read.parquet(f"{folder}/rows-{k}").withColumn("batch", F.lit(k))
        again = spark.read.parquet(f"{folder}/replayed-{k}").withColumn("since", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
        replays = again if replays is None else replays.unionByName(again)
    since = replays.groupBy(*PLAYER).agg(F.max("since").alias("since"))
    valid = F.col("batch") >= F.coalesce("since", F.lit(0))
    return rows.join(since, list(PLAYER), "left").where(valid).drop("batch", "since")
