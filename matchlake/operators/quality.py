"""Integrity checks of matches and between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import values
from .segments import SEGMENT, before, split

# Fixed bounds of the checks, inclusive.
MAX_INT = 2147483647
DEFAULT_RANGE = (0, 214748364)
EARLIEST_START_MS = 1104537600000
CLOCK_TOLERANCE_MS = 60000
STATUS_RANGES = {"tower_status": (0, 2048), "barracks_status": (0, 64)}
MATCH_RANGES = {
    "cluster": (0, 1073741823),
    "season": (0, 1073741823),
    "duration": (0, 1073741823),
    "negative_votes": (0, 1073741823),
    "positive_votes": (0, 1073741823),
    "league_id": (0, MAX_INT),
}
PLAYER_RANGES = {
    "assists": (0, 1000),
    "deaths": (0, 1000),
    "denies": (0, 5000),
    "gold": (0, 10000),
    "gold_spent": (0, 1000000),
    "hero_damage": DEFAULT_RANGE,
    "hero_healing": DEFAULT_RANGE,
    "hero_id": (0, 200),
    "kills": (0, 1000),
    "last_hits": (0, 10000),
    "player_slot": (0, 256),
    "level": (0, 25),
    "gold_per_minute": (0, 200000),
    "exp_per_minute": (0, 200000),
}
ABILITY_RANGES = {
    "level": ("ability upgrade level", (0, 25)),
    "time": ("ability upgrade time", (0, 1000000)),
    "ability_id": ("ability id", DEFAULT_RANGE),
}

# Longest array one row is repeated with.
_COPIES = 1 << 20


def _in_range(value: Column, name: str, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return (
        F.when(value.isNull(), f"{name} was null")
        .when(value < low, f"{name} was smaller then {low}")
        .when(value > high, f"{name} was larger then {high}")
    )


def _known(value: Column, name: str, low: int, high: int) -> Column:
    return F.when(~F.coalesce(value.between(low, high), F.lit(False)), f"{name} unknown")


def _first_of(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m.isNotNull()), F.lit(0))


def _ability_fault(ability: Column) -> Column:
    checks = (_in_range(ability[f], name, bounds) for f, (name, bounds) in ABILITY_RANGES.items())
    return F.coalesce(*checks)


def _player_fault(p: Column) -> Column:
    account = F.when(values.non_anonymous(p["account_id"]), p["account_id"])
    status = p["leaver_status"]
    return F.coalesce(
        F.when(account.isNotNull(), _in_range(account, "account_id", (0, MAX_INT))),
        F.when(
            status.isNotNull(), _known(status, "leaver_status", 0, len(fixed.LEAVER_STATUSES) - 1)
        ),
        *(_in_range(p[f], f, bounds) for f, bounds in PLAYER_RANGES.items()),
        _in_range(F.size(p["ability_upgrades"]), "ability upgrade size", (0, 25)),
        _first_of(F.transform(p["ability_upgrades"], _ability_fault)),
    )


def first_fault(as_of_ms: int) -> Column:
    """Message of the first rule a match breaks, null if it breaks none."""
    lobbies = (fixed.FIRST_LOBBY_TYPE, fixed.FIRST_LOBBY_TYPE + len(fixed.LOBBY_TYPES) - 1)
    sides = ("dire", "radiant")
    stored = {"tower_status": "towers_status", "barracks_status": "barracks_status"}
    latest = as_of_ms + CLOCK_TOLERANCE_MS
    return F.coalesce(
        _in_range(F.col("start_ms"), "start_time", (EARLIEST_START_MS, latest)),
        *(
            _in_range(F.col(f"{side}_{stored[name]}"), f"{side}_{name}", bounds)
            for name, bounds in STATUS_RANGES.items()
            for side in sides
        ),
        _in_range(F.col("human_players"), "human_players", (0, 10)),
        _known(F.col("lobby_type"), "lobby_type", *lobbies),
        _known(F.col("game_mode"), "game_mode", 0, len(fixed.GAME_MODES) - 1),
        *(_in_range(F.col(f), f, bounds) for f, bounds in MATCH_RANGES.items()),
        _first_of(F.transform("players", _player_fault)),
    )


def validate_matches(matches: DataFrame, as_of_ms: int) -> DataFrame:
    """Matches per first broken rule. ``as_of_ms`` bounds the start time."""
    faults = matches.select(first_fault(as_of_ms).alias("message"))
    return (
        faults.where(F.col("message").isNotNull())
        .groupBy("message")
        .agg(F.count("*").alias("matches"))
    )


def _repeat(df: DataFrame, copies: str) -> DataFrame:
    """Each row ``copies`` times, through arrays of bounded length."""
    n = F.col(copies)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {_COPIES}")))
    size = F.least(n - F.col("chunk") * _COPIES, F.lit(_COPIES).cast("long"))
    return (
        df.withColumn("chunk", chunk)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
        .drop("chunk", "copy", copies)
    )


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key on either side: one shuffle, combined before it."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return tagged.groupBy(key).agg(F.sum("l").alias("left"), F.sum("r").alias("right"))


def compare_match_ids(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Match ids that only one of two sources has; repeated ids stay repeated.

    A null id equals no other, so every null of either side gives a row of two nulls.
    """
    left, right = F.col("left"), F.col("right")
    unmatched = (left == 0) | (right == 0) | F.col("match_id").isNull()
    one_sided = _sides(records, matches, "match_id").where(unmatched)
    ids = one_sided.select(
        F.when(right == 0, F.col("match_id")).alias("record_match_id"),
        F.when(left == 0, F.col("match_id")).alias("table_match_id"),
        (left + right).alias("copies"),
    )
    return _repeat(ids, "copies")


def compare_player_counts(records: DataFrame, player_matches: DataFrame) -> DataFrame:
    """Accounts whose number of matches differs between raw records and the table.

    ``records`` are raw, with unsigned account ids. A missing side is null.
    """
    raw = (
        records.select(F.explode("players.account_id").alias("raw_id"))
        .where(F.col("raw_id").isNotNull() & (F.col("raw_id") != fixed.RAW_ANONYMOUS))
        .select(values.signed_account_id(F.col("raw_id")).cast("long").alias("account_id"))
    )
    stored = player_matches.where(F.col("match_id").isNotNull()).select(
        F.col("account_id").cast("long").alias("account_id")
    )
    left, right = F.col("left"), F.col("right")
    return (
        _sides(raw, stored, "account_id")
        .where(left != right)
        .select(
            "account_id",
            F.when(left > 0, left).alias("record_matches"),
            F.when(right > 0, right).alias("table_matches"),
        )
    )


def count_unique_match_ids(records: DataFrame) -> DataFrame:
    return records.agg(F.count_distinct("match_id").alias("match_ids"))


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"))


def count_cells(table: DataFrame, column: str) -> DataFrame:
    """Cells of a column over all rows and versions."""
    return table.agg(F.count(column).alias("cells"))


def matches_for_player(records: DataFrame, player_id: int) -> DataFrame:
    """Match ids of raw records that contain one account."""
    played = F.exists(
        "players", lambda p: F.coalesce(p["account_id"] == player_id, F.lit(False))
    )
    return records.where(played).select("match_id")


def max_account_id(records: DataFrame) -> DataFrame:
    """Highest account id of raw records, anonymous players left out."""
    ids = F.filter("players.account_id", lambda a: a != fixed.RAW_ANONYMOUS)
    return records.agg(F.max(F.array_max(ids)).alias("max_account_id"))


def example_values(matches: DataFrame, field: str, examples: int = 10) -> DataFrame:
    """Up to ``examples`` matches for each value of a player field, by match id.

    An example names the first player of the match with that value. Values are
    made distinct inside the match row, and ranking keeps few rows per value
    before the shuffle, so a common value is as cheap as a rare one.
    """
    texts = F.transform("players", lambda p: F.coalesce(p[field].cast("string"), F.lit("null")))
    per_match = matches.select(
        "match_id", texts.alias("texts"), F.col("players.player_slot").alias("slots")
    )
    found = per_match.select(
        "match_id", "texts", "slots", F.explode(F.array_distinct("texts")).alias("value")
    ).select(
        "value",
        "match_id",
        F.get("slots", F.array_position("texts", F.col("value")).cast("int") - 1).alias("player_slot"),
    )
    by_id = Window.partitionBy("value").orderBy("match_id", "player_slot")
    return (
        found.withColumn("n", F.row_number().over(by_id))
        .where(F.col("n") <= examples)
        .withColumn("slot", values.team_slot(F.col("player_slot")))
    )


def example_summaries(found: DataFrame) -> DataFrame:
    """One text per value, with a line for each example."""
    line = F.concat(
        F.lit("Match: "), "match_id", F.lit(" player: "), "player_slot", F.lit(" ("), "slot", F.lit(")")
    )
    lines = F.sort_array(F.collect_list(F.struct("n", line.alias("line"))))
    return found.groupBy("value").agg(
        F.count("*").alias("examples"),
        F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("summary"),
    )


def sequence_gaps(files: DataFrame, **sizes: int) -> DataFrame:
    """Neighbouring file ranges that do not meet: gaps and overlaps.

    File names look like ``matches_<start>-<end>.gz``. The files are put in
    order of (start, end) in segments, so a long list is not sorted in one task.
    """
    bound = r"matches_(\d+)-(\d+)"
    ranges = files.select(
        F.lit(0).alias("list"),
        F.regexp_extract("file_name", bound, 1).cast("long").alias("start"),
        F.regexp_extract("file_name", bound, 2).cast("long").alias("end"),
    )
    cut = split(ranges, ("list",), "start", **sizes)
    last_end = F.max_by("end", F.struct("start", "end"))
    carried = (
        cut.large_rows.groupBy("list", SEGMENT)
        .agg(last_end.alias("last_end"))
        .withColumn("carried_end", F.last("last_end").over(before(cut.over_segments)))
        .select("list", SEGMENT, "carried_end")
    )
    w = Window.partitionBy("list", SEGMENT).orderBy("start", "end")
    rows = cut.attach(cut.rows.withColumn("local_end", F.lag("end").over(w)), carried)
    previous = F.coalesce("local_end", "carried_end")
    return rows.where(previous != F.col("start")).select(
        previous.alias("previous_end"), F.col("start").alias("next_start")
    )
