"""Registered queries: every operator over the whole tables of a folder.

Each takes ``(spark, sf_dir)``. Nested results are flattened and computed
doubles rounded, so that they compare with the SQL of :mod:`.oracles`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import values
from ..operators import (
    classify,
    clusters,
    correlation,
    decode,
    derive,
    herostats,
    histogram,
    ingest,
    picks,
    progress,
    quality,
    skill,
    timeline,
)
from ..session import shared_folder
from ..sources import cell_store, cells, dimensions
from ..sources import telemetry as source
from . import chains

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters fit the size of the test tables.
SLOT, DAY = 10800, 86400
WINDOW, STEP, SLOT_MIN_GAMES = 9, 8, 20
DROP_FIRST, MIN_GAMES = 2, 1
PICK_SIZE, ROW_SIZE = 10, 5
BURN_IN = 3
GAMES_WINDOW = 5
FIRST_HERO, LAST_HERO = 1, 21
CLUSTERS, ITERATIONS = 3, 2
AS_OF_MS = 1735689600000
HISTOGRAM_COLUMNS = ["game_mode", "lobby_type"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to nine digits, without negative zeros."""

    def tidy(c: str) -> Column:
        short = F.round(F.col(c), 9)
        return F.when(short == 0, F.lit(0.0)).otherwise(short)

    return df.withColumns({c: tidy(c) for c in columns})


def _text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",", "null")


def _matches(spark: SparkSession, sf_dir: str, *player_fields: str) -> DataFrame:
    return source.matches(spark, sf_dir, player_fields)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.raw_match_lines(source.matches(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str, *player_fields: str) -> DataFrame:
    schema = schemas.narrow_raw_match(*player_fields)
    return ingest.parse_lines(_lines(spark, sf_dir), schema)


# --- ingest -----------------------------------------------------------------------------


def _flat_player(p: Column) -> list[Column]:
    plain = [
        f
        for f in schemas.PLAYER.fieldNames()
        if f not in ("ability_upgrades", "item_ids", "additional_units")
    ]
    upgrades = F.transform(
        p["ability_upgrades"], lambda a: F.concat_ws(":", a["level"], a["ability_id"], a["time"])
    )
    return [
        *(p[f].alias(f) for f in plain),
        F.array_join(upgrades, ",").alias("ability_upgrades"),
        _text(p["item_ids"]).alias("item_ids"),
        p["additional_units"]["name"].alias("unit_name"),
        _text(p["additional_units"]["item_ids"]).alias("unit_item_ids"),
    ]


@query
def ingest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = ingest.ingest_matches(_lines(spark, sf_dir))
    scalars = schemas.MATCH_SCALARS.fieldNames()
    return matches.select(*scalars, F.posexplode("players").alias("pos", "p")).select(
        *scalars, "pos", *_flat_player(F.col("p"))
    )


@query
def ingest_player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.ingest_player_matches(_lines(spark, sf_dir))
    return rows.select(
        "account_id",
        "ts",
        "match_id",
        "game_mode",
        "lobby_type",
        "season",
        "radiant_win",
        "duration",
        F.col("player.hero_id").alias("hero_id"),
        F.col("player.player_slot").alias("player_slot"),
        F.col("player.gold").alias("gold"),
        F.size("other_players").alias("others"),
        _text(F.col("other_players.account_id")).alias("other_accounts"),
        _text(F.col("other_players.hero_id")).alias("other_heroes"),
    )


@query
def tolerant_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = source.corrupt_some(_lines(spark, sf_dir))
    good = ingest.parse_good_lines(lines)
    return good.select("match_id", "game_mode", F.size("players").alias("players"))


@query
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.count_malformed(source.corrupt_some(_lines(spark, sf_dir)))


@query
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.malformed(source.corrupt_more(_lines(spark, sf_dir)))
    match_id = F.regexp_extract("line", r'"match_id":(\d+)', 1)
    known = F.when(match_id != "", match_id).cast("long")
    return rows.select(known.alias("match_id"), "reason")


@query
def hero_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.hero_names(source.hero_document(spark, sf_dir))


# --- classification and derived values --------------------------------------------------


@query
def real_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.real_matches(_matches(spark, sf_dir, "leaver_status"))


@query
def real_match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.real_match_counters(_matches(spark, sf_dir, "leaver_status"))


@query
def transfer_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(derive.transfer(source.derived_matches(spark, sf_dir)), "value")


@query
def transfer_derived_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.transfer(source.derived_matches(spark, sf_dir), "real_.*")


@query
def games_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.games_played(source.player_timeline(spark, sf_dir))


# --- versioned cells --------------------------------------------------------------------


def _player_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = derive.transfer(source.derived_matches(spark, sf_dir))
    return moved.withColumnRenamed("account_id", "entity")


@query
def match_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = cells.from_map(source.derived_matches(spark, sf_dir), "match_id", "start_ms", "derived")
    return _rounded(cells.matching(family, "first_blood_.*|real_match"), "value")


@query
def latest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cells.latest(_player_cells(spark, sf_dir)), "value")


def _puts(stored: DataFrame) -> DataFrame:
    return cells.matching(stored, "real_match").select(
        "entity",
        "qualifier",
        # Odd entities are overwritten, even ones get a new version.
        F.when(F.col("entity") % 2 == 1, F.col("ts")).otherwise(F.col("ts") + 1).alias("ts"),
        (F.col("value") + 10).alias("value"),
    )


@query
def upsert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _player_cells(spark, sf_dir)
    return _rounded(cells.upsert(stored, _puts(stored)), "value")


@query
def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = cell_store.CellStore(spark, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}", buckets=4)
    cells_now = _player_cells(spark, sf_dir)
    store.put(cells_now)
    # The same puts as in ``upsert_cells``, in two batches with a compaction between.
    puts = _puts(cells_now)
    store.put(puts.where("entity % 2 = 0"))
    store.compact()
    store.put(puts.where("entity % 2 <> 0"))
    return _rounded(store.read(), "value")


@query
def hero_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(herostats.hero_cells(_rates(spark, sf_dir, DAY), DAY), "value")


@query
def sliding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(herostats.sliding_cells(_sliding(spark, sf_dir), SLOT, STEP), "value")


@query
def row_number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = picks.player_row_numbers(source.player_timeline(spark, sf_dir), ROW_SIZE)
    return picks.row_number_cells(numbers, ROW_SIZE)


# --- hero statistics and skill ----------------------------------------------------------


def _rates(spark: SparkSession, sf_dir: str, interval: int) -> DataFrame:
    matches = _matches(spark, sf_dir, "hero_id", "player_slot", "leaver_status")
    return herostats.hero_win_rates(matches, interval)


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return herostats.sliding_hero_win_rates(
        _rates(spark, sf_dir, SLOT), SLOT, WINDOW, STEP, SLOT_MIN_GAMES
    )


def _raw_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = source.player_timeline(spark, sf_dir)
    return skill.hero_skill_raw(games, DROP_FIRST, MIN_GAMES, "ver_us")


@query
def hero_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rates(spark, sf_dir, SLOT), "win_rate")


@query
def sliding_hero_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sliding(spark, sf_dir), "win_rate")


@query
def hero_skill_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_raw_skill(spark, sf_dir), "score")


@query
def hero_skill_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = skill.hero_skill_adjusted(
        source.player_timeline(spark, sf_dir),
        _rates(spark, sf_dir, DAY),
        DAY,
        DROP_FIRST,
        MIN_GAMES,
        "ver_us",
        "ver_ms",
    )
    return _rounded(scores, "score")


# --- correlations -----------------------------------------------------------------------


def _pick_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.pick_triples(source.player_timeline(spark, sf_dir), PICK_SIZE)


def _players(spark: SparkSession, sf_dir: str) -> Column:
    """Number of distinct accounts, as the vector length."""
    accounts = source.match_players(spark, sf_dir, ("account_id",))
    known = accounts.where(values.non_anonymous(F.col("account_id")))
    return known.agg(F.count_distinct("account_id")).scalar()


def _tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = skill.as_triples(_raw_skill(spark, sf_dir))
    return correlation.shared_correlations(triples, size_filter=0)


@query
def tuple_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tuples(spark, sf_dir), "cor")


@query
def pick_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.range_correlations(
        _pick_triples(spark, sf_dir), _players(spark, sf_dir), FIRST_HERO, LAST_HERO
    )
    return _rounded(found, "cor")


@query
def inmem_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.present_correlations(_pick_triples(spark, sf_dir), _players(spark, sf_dir))
    return _rounded(found, "cor")


@query
def matrix_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.matrix_correlations(_pick_triples(spark, sf_dir), _players(spark, sf_dir))
    return _rounded(found, "cor")


@query
def named_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = correlation.named_correlations(
        _tuples(spark, sf_dir), source.hero_dimension(spark), min_size=4
    )
    return _rounded(named, "cor")


@query
def supply_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = source.supply_triples(spark, sf_dir)
    return _rounded(correlation.shared_correlations(triples, size_filter=1), "cor")


@query
def skill_correlation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = chains.skill_correlation(
        _matches(spark, sf_dir, "hero_id", "player_slot", "leaver_status"),
        source.player_timeline(spark, sf_dir),
        source.hero_dimension(spark),
        start_interval=SLOT,
        window_size=WINDOW,
        window_step=STEP,
        slot_min_games=SLOT_MIN_GAMES,
        drop_first=DROP_FIRST,
        min_games=MIN_GAMES,
        size_filter=0,
        order="ver_us",
        time_ms="ver_ms",
    )
    return _rounded(named, "cor")


# --- picks and clusters -----------------------------------------------------------------


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = source.player_timeline(spark, sf_dir)
    return picks.hero_pick_share(games, picks.player_row_numbers(games, ROW_SIZE))


@query
def hero_pick_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_shares(spark, sf_dir), "share")


@query
def player_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.player_row_numbers(source.player_timeline(spark, sf_dir), ROW_SIZE)


@query
def pick_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = picks.pick_vectors(_shares(spark, sf_dir))
    return vectors.select(
        "hero_id",
        "block",
        F.size("indices").alias("entries"),
        _text(F.col("indices")).alias("indices"),
        _text(F.transform("values", lambda v: F.round(v, 9))).alias("shares"),
    )


@query
def hero_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = clusters.hero_clusters(_shares(spark, sf_dir), CLUSTERS, ITERATIONS)
    return clusters.name_clusters(assigned, source.hero_dimension(spark))


# --- timelines --------------------------------------------------------------------------


@query
def streak_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.streak_values(source.player_timeline(spark, sf_dir), BURN_IN, "ver_us")


def _advanced(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The timeline in three batches by time; some games of the first reach the last one late."""
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    timeline = source.player_timeline(spark, sf_dir).select("account_id", "ver_us", "match_id", "win", "real_match")
    # Every batch reads the games again: they are made from the events once.
    timeline.write.parquet(f"{folder}/games")
    games = spark.read.schema(timeline.schema).parquet(f"{folder}/games")
    span = games.agg(F.min("ver_us").alias("low"), F.max("ver_us").alias("high")).first()
    third = (F.col("ver_us") - F.lit(span.low)) * 3 / F.lit(span.high - span.low + 1)
    dealt = games.withColumn("batch", F.when(F.col("match_id") % 37 == 5, 2).otherwise(F.floor(third)))
    for number in range(3):
        own, upto = (dealt.where(c).drop("batch") for c in (F.col("batch") == number, F.col("batch") <= number))
        progress.advance_tables(spark, folder, number, own, upto, "ver_us")
    return folder, 2


@query
def advanced_streak_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress.current_rows(spark, *_advanced(spark, sf_dir))
    return rows.where(F.col("real_no") > BURN_IN).select("account_id", "ver_us", "streak")


@query
def advanced_games_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, last = _advanced(spark, sf_dir)
    return progress.games_played(spark.read.parquet(f"{folder}/state-{last}"))


@query
def streak_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.streak_win_rate(source.player_timeline(spark, sf_dir), BURN_IN, "ver_us")
    return _rounded(found, "win_rate")


@query
def win_rate_vs_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.win_rate_vs_games(source.player_timeline(spark, sf_dir), GAMES_WINDOW, "ver_us")
    return _rounded(found, "mean", "stdev")


@query
def group_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.group_win_rate(source.player_timeline(spark, sf_dir), "real_match")
    return _rounded(found, "mean", "stdev")


# --- histograms -------------------------------------------------------------------------


@query
def winner_rax_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.winner_rax_counts(_matches(spark, sf_dir, "leaver_status"))


@query
def winner_rax_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = histogram.winner_rax_counts(_matches(spark, sf_dir, "leaver_status"))
    return _rounded(histogram.winner_rax_percent(counts), "percent")


@query
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(_matches(spark, sf_dir), "game_mode", DAY)


@query
def multi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.multi_histogram(_matches(spark, sf_dir), HISTOGRAM_COLUMNS, DAY)


@query
def value_histogram_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.key_histogram(
        _matches(spark, sf_dir),
        histogram.value_key("data", "game_mode", 21600),
        histogram.value_key("data", "season", 21600),
        histogram.value_key("data", "season"),
    )


@query
def weekly_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.weekly_counts(_matches(spark, sf_dir), HISTOGRAM_COLUMNS, DAY)


@query
def weekly_histogram_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = chains.weekly_counts(_matches(spark, sf_dir), HISTOGRAM_COLUMNS, DAY)
    return histogram.unpivot_weeks(histogram.weekly_histogram_wide(weekly, "game_mode"))


# --- integrity checks -------------------------------------------------------------------


@query
def validate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_matches(source.matches(spark, sf_dir), AS_OF_MS)


@query
def compare_match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _matches(spark, sf_dir).select("match_id")
    kept = ids.where("match_id % 40 <> 0")
    added = ids.where("match_id % 60 = 0").select((F.col("match_id") + 1_000_000).alias("match_id"))
    unknown = ids.where("match_id % 70 = 0").select(F.lit(None).cast("long").alias("match_id"))
    known = F.when(F.col("match_id") % 90 != 1, F.col("match_id")).alias("match_id")
    stored = kept.unionByName(added).unionByName(unknown)
    return quality.compare_match_ids(_records(spark, sf_dir).select(known), stored)


@query
def compare_player_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = source.match_players(spark, sf_dir, ("account_id", "event_id"))
    stored = seats.where(values.non_anonymous(F.col("account_id")) & (F.col("event_id") % 45 != 0))
    return quality.compare_player_counts(_records(spark, sf_dir, "account_id"), stored)


@query
def count_unique_match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_unique_match_ids(_records(spark, sf_dir))


@query
def count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_lines(_lines(spark, sf_dir))


@query
def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_cells(source.player_timeline(spark, sf_dir), "real_match")


@query
def matches_for_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.matches_for_player(_records(spark, sf_dir, "account_id"), 1)


@query
def max_account_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = source.corrupt_some(_lines(spark, sf_dir))
    return quality.max_account_id(ingest.parse_good_lines(lines, schemas.narrow_raw_match("account_id")))


@query
def example_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _matches(spark, sf_dir, "leaver_status", "player_slot")
    return quality.example_summaries(quality.example_values(matches, "leaver_status"))


@query
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sequence_gaps(source.match_files(spark, sf_dir))


# --- decoding ---------------------------------------------------------------------------


@query
def decode_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode.decode_matches(_matches(spark, sf_dir))
    flat = []
    for side in ("dire", "radiant"):
        for group in ("towers", "barracks"):
            struct = f"{side}_{group}"
            for field in decoded.schema[struct].dataType.fieldNames():
                flat.append(F.col(f"{struct}.{field}").alias(f"{side}_{field}"))
            flat.append(F.col(f"{struct}_standing"))
    return decoded.select(
        "match_id", "game_mode_name", "lobby_type_name", "serious_game", "serious_lobby", *flat
    )


@query
def decode_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _matches(
        spark, sf_dir, "player_slot", "account_id", "leaver_status", "hero_id", "item_ids"
    )
    return decode.decode_players(matches, source.hero_dimension(spark), source.item_dimension(spark))
