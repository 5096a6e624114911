"""Order-sensitive analyses of player timelines: streaks, sliding and grouped win rates.

Timelines have one row per game of an ``account_id``, with ``win`` and the match's
``real_match`` status. Oldest games come first; games at one ``order`` come by ``match_id``,
where the timeline has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .segments import SEGMENT, before, split, up_to

PLAYER = ("account_id",)


def _ties(timeline: DataFrame) -> tuple[str, ...]:
    return ("match_id",) if "match_id" in timeline.columns else ()


def signed_streaks(timeline: DataFrame, order: str, **sizes: int) -> DataFrame:
    """Games with real_match >= 2 and the signed streak each is entered with.

    A streak is the distance to the last change between a win and a loss, so it
    needs only a running count of real games and a running maximum of the
    change points. ``game_no`` counts all games of the player, ``real_no`` the
    real ones. Other games neither break nor extend a streak.
    """
    ties = _ties(timeline)
    cut = split(timeline.select(*PLAYER, order, *ties, "win", "real_match"), PLAYER, order, ties=ties, **sizes)

    def local(rows: DataFrame) -> DataFrame:
        w = cut.window
        real = F.coalesce(F.col("real_match") >= fixed.REAL_MATCH, F.lit(False))
        result = F.when(F.col("real"), F.col("win"))
        return (
            rows.withColumn("real", real)
            .withColumns(
                {
                    "local_game": F.count("*").over(up_to(w)),
                    "local_real": F.count_if("real").over(up_to(w)),
                    "first_result": F.first(result, ignorenulls=True).over(up_to(w)),
                    "local_previous": F.last(result, ignorenulls=True).over(before(w)),
                }
            )
            .withColumn(
                "local_turn",
                F.when(F.col("real") & (F.col("win") != F.col("local_previous")), F.col("local_real")),
            )
        )

    # Per segment of a large player: what later segments must know.
    last_real = F.max_by("win", F.when(F.col("real"), cut.place))
    summary = (
        local(cut.large_rows)
        .groupBy(*PLAYER, SEGMENT)
        .agg(
            F.count("*").alias("games"),
            F.count_if("real").alias("reals"),
            F.min_by("win", F.when(F.col("real"), cut.place)).alias("first_win"),
            last_real.alias("last_win"),
            F.max("local_turn").alias("last_turn"),
        )
    )
    ws = cut.over_segments
    nothing = F.lit(0).cast("long")
    carried = (
        summary.withColumn("games_before", F.coalesce(F.sum("games").over(before(ws)), nothing))
        .withColumn("reals_before", F.coalesce(F.sum("reals").over(before(ws)), nothing))
        .withColumn("carried_previous", F.last("last_win", ignorenulls=True).over(before(ws)))
        .withColumn(
            "turn",
            F.col("reals_before")
            + F.coalesce(
                "last_turn",
                F.when(
                    F.col("first_win").isNotNull()
                    & ~F.col("first_win").eqNullSafe(F.col("carried_previous")),
                    F.lit(1),
                ),
            ),
        )
        .withColumn("carried_turn", F.max("turn").over(before(ws)))
        .select(*PLAYER, SEGMENT, "games_before", "reals_before", "carried_previous", "carried_turn")
    )

    rows = local(cut.rows).withColumn("earlier_turn", F.max("local_turn").over(before(cut.window)))
    rows = cut.attach(rows.where("real"), carried)
    games_before = F.coalesce("games_before", nothing)
    reals_before = F.coalesce("reals_before", nothing)
    # The segment's first real game is a turn unless it repeats the carried result.
    opening_turn = F.when(
        F.col("local_previous").isNotNull()
        & ~F.col("first_result").eqNullSafe(F.col("carried_previous")),
        reals_before + 1,
    )
    last_turn = F.coalesce(reals_before + F.col("earlier_turn"), opening_turn, F.col("carried_turn"))
    previous = F.coalesce("local_previous", "carried_previous")
    real_no = reals_before + F.col("local_real")
    length = real_no - last_turn
    streak = F.when(previous.isNull(), nothing).when(previous, length).otherwise(-length)
    return rows.select(
        *PLAYER,
        order,
        *ties,
        "win",
        (games_before + F.col("local_game")).alias("game_no"),
        real_no.alias("real_no"),
        streak.cast("int").alias("streak"),
    )


def streak_values(timeline: DataFrame, burn_in: int, order: str = "ts", **sizes: int) -> DataFrame:
    """Signed streak entering each real game; the burn-in counts real games."""
    streaks = signed_streaks(timeline, order, **sizes)
    return streaks.where(F.col("real_no") > burn_in).select(*PLAYER, order, "streak")


def streak_win_rate(timeline: DataFrame, burn_in: int, order: str = "ts", **sizes: int) -> DataFrame:
    """Win rate of the next game per streak value; the burn-in counts all games."""
    streaks = signed_streaks(timeline, order, **sizes)
    return (
        streaks.where(F.col("game_no") > burn_in)
        .groupBy("streak")
        .agg(F.avg(F.col("win").cast("int")).alias("win_rate"), F.count("*").alias("games"))
    )


def win_rate_windows(
    timeline: DataFrame, window_size: int, order: str = "ts", **sizes: int
) -> DataFrame:
    """Win rate of every ``window_size`` consecutive real games of a player.

    Windows are numbered from 1, oldest first. A player with fewer games has
    one short window. Segments of a large player borrow the next games from
    later segments, so no window is lost at a cut.
    """
    ties = _ties(timeline)
    real = timeline.where(F.col("real_match") >= fixed.REAL_MATCH).select(*PLAYER, order, *ties, "win")
    cut = split(real, PLAYER, order, ties=ties, **sizes)

    numbered = cut.large_rows.withColumn("local_no", F.row_number().over(cut.window))
    ws = cut.over_segments
    offsets = (
        cut.large_rows.groupBy(*PLAYER, SEGMENT)
        .agg(F.count("*").alias("games"))
        .withColumn("through", F.sum("games").over(up_to(ws)))
        .withColumn("place", F.row_number().over(ws))
        .withColumn("games_before", F.col("through") - F.col("games"))
    )
    # The first games of a segment, lent to the few segments that end shortly before them.
    lendable = cut.attach(
        numbered.where(F.col("local_no") < window_size),
        offsets.select(*PLAYER, SEGMENT, "place", "games_before"),
    ).withColumn("game_no", F.col("games_before") + F.col("local_no"))
    borrowers = offsets.select(*PLAYER, "place", F.col(SEGMENT).alias("borrower"), "through")
    steps_back = F.explode(F.sequence(F.lit(1), F.lit(max(window_size - 1, 1))))
    lent = (
        lendable.withColumn("back", steps_back)
        .withColumn("place", F.col("place") - F.col("back"))
        .join(F.broadcast(borrowers), [*PLAYER, "place"])
        .where(F.col("game_no") < F.col("through") + window_size)
        .select(*PLAYER, order, *ties, "win", F.col("borrower").alias(SEGMENT), F.lit(True).alias("lent"))
    )
    offsets = offsets.select(*PLAYER, SEGMENT, "games_before")

    rows = cut.rows.withColumn("lent", F.lit(False)).unionByName(lent)
    ahead = cut.window.rowsBetween(Window.currentRow, window_size - 1)
    windows = (
        rows.withColumns(
            {
                "local_no": F.row_number().over(cut.window),
                "games": F.count("*").over(ahead),
                "wins": F.count_if("win").over(ahead),
            }
        )
        .where(~F.col("lent"))
    )
    windows = cut.attach(windows, offsets).withColumn(
        "window_no", F.coalesce("games_before", F.lit(0).cast("long")) + F.col("local_no")
    )
    full = F.col("games") == window_size
    return windows.where(full | (F.col("window_no") == 1)).select(
        *PLAYER, "window_no", (F.col("wins") / F.col("games")).alias("win_rate")
    )


def win_rate_vs_games(
    timeline: DataFrame, window_size: int, order: str = "ts", **sizes: int
) -> DataFrame:
    """Size, mean and population deviation of the sliding win rate per window number."""
    windows = win_rate_windows(timeline, window_size, order, **sizes)
    return windows.groupBy("window_no").agg(
        F.count("*").alias("size"),
        F.avg("win_rate").alias("mean"),
        F.stddev_pop("win_rate").alias("stdev"),
    )


def group_win_rate(timeline: DataFrame, column: str) -> DataFrame:
    """Size, mean and population deviation of wins per value of a derived column."""
    won = F.col("win").cast("int")
    return (
        timeline.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("size"), F.avg(won).alias("mean"), F.stddev_pop(won).alias("stdev"))
    )
