"""Match and player tables as views over an ``events`` table.

Ten consecutive event ids make one match, one event per player seat; every
other column follows from the ids, the value and ``props.k``. The views have
the schemas of the match and player tables, so all operators run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..operators import classify, derive
from ..schemas import ITEM_FIELDS, PLAYER
from ..session import configure

RECORD_FIELDS = tuple(PLAYER.fieldNames())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player seat, with the event's own time as version."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_id div 10 AS match_id",
        "CAST(event_id % 10 AS INT) AS pos",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS ver_us",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ver_ms",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "value AS v",
        "user_id",
    )


_ITEMS = "transform(sequence(0, 5), i -> (k + i * 37) % 241)"
_UPGRADES = (
    "transform(sequence(1, k % 5 + 1),"
    " i -> named_struct('level', i, 'ability_id', i + 5000, 'time', i * 60))"
)

# Player fields over the columns of a seat. The last three lie beside the stored
# record: the seat's own version and row id.
PLAYER_SQL = {
    "gold_spent": "CAST(floor(v * 100) AS INT)",
    "gold": "CAST(floor(v * 40) AS INT)",
    "deaths": "CAST(event_id * 7 % 25 AS INT)",
    "hero_damage": "CAST(floor(v * 200) AS INT)",
    "last_hits": "CAST(event_id * 13 % 400 AS INT)",
    "player_slot": "IF(pos < 5, pos, pos + 123)",
    "denies": "CAST(event_id * 5 % 50 AS INT)",
    "ability_upgrades": f"slice({_UPGRADES}, 1, IF(k % 10 = 0, 0, 5))",
    "tower_damage": "CAST(floor(v * 30) AS INT)",
    "hero_id": "k % 20 + 1",
    "exp_per_minute": "v * 1.5D",
    "account_id": f"CASE WHEN user_id % 15 = 0 THEN {fixed.ANONYMOUS}"
    " WHEN user_id % 50 = 7 THEN NULL ELSE CAST(user_id AS INT) END",
    "kills": "k % 30",
    "leaver_status": "CASE WHEN user_id % 50 = 7 THEN NULL"
    " WHEN k >= 98 THEN 2 WHEN k >= 93 THEN 1 ELSE 0 END",
    "hero_healing": "CAST(floor(v * 10) AS INT)",
    "assists": "CAST(event_id * 3 % 40 AS INT)",
    "gold_per_minute": "v",
    "level": "IF(k = 77, 26, k % 25 + 1)",
    "item_ids": _ITEMS,
    "additional_units": f"IF(k % 25 IN (3, 4), named_struct('name', 'spirit_bear', 'item_ids', {_ITEMS}), NULL)",
    "ver_us": "ver_us",
    "ver_ms": "ver_ms",
    "event_id": "event_id",
}

MATCH_SQL = {
    "match_id": "match_id",
    "start_ms": "start_ms",
    "dire_towers_status": "CAST(match_id * 211 % 2048 AS INT)",
    "radiant_towers_status": "CAST(match_id * 101 % 2048 AS INT)",
    "dire_barracks_status": "CAST(match_id * 53 % 64 AS INT)",
    "radiant_barracks_status": "CAST(match_id * 37 % 64 AS INT)",
    "cluster": "CAST(match_id % 10 + 111 AS INT)",
    "season": "IF(match_id % 10 = 0, NULL, CAST(match_id % 5 AS INT))",
    "game_mode": "IF(match_id % 97 = 0, 99, CAST(match_id % 15 AS INT))",
    "match_seq_num": "match_id * 3 + 1",
    "league_id": "CAST(match_id % 7 AS INT)",
    "first_blood_time": "CAST(match_id % 600 AS INT)",
    "negative_votes": "CAST(match_id % 4 AS INT)",
    "duration": "IF(match_id % 31 = 0, -1, CAST(match_id % 3600 + 600 AS INT))",
    "radiant_win": "k_sum % 2 = 0",
    "positive_votes": "CAST(match_id % 6 AS INT)",
    "lobby_type": "CAST(match_id * 7 % 8 - 1 AS INT)",
    "human_players": "IF(match_id % 20 = 0, 9, 10)",
}


def matches(
    spark: SparkSession, sf_dir: str, player_fields: tuple[str, ...] = RECORD_FIELDS
) -> DataFrame:
    """One row per match, with the named player fields; without any, no players.

    Seats of a match are brought together as the narrow source rows they are and
    made into players afterwards: a list of all rows has nothing to combine
    earlier, and the player records are several times as wide.
    """
    rows = seats(spark, sf_dir)
    sums = ["min(ver_ms) AS start_ms", "sum(k) AS k_sum"]
    columns = [f"{text} AS {name}" for name, text in MATCH_SQL.items()]
    if player_fields:
        # Work per match outweighs its bytes: keep all partitions, however small.
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(partitions, "match_id")
        seat = ", ".join(f"'{name}', {PLAYER_SQL[name]}" for name in player_fields)
        # Ten seats at most, by the definition of the match id.
        listed = f"sort_array(collect_list(named_struct('pos', pos, 'player', named_struct({seat}))))"
        sums.append(f"{listed} AS seated")
        columns.append("seated.player AS players")
    return rows.groupBy("match_id").agg(*map(F.expr, sums)).selectExpr(*columns)


def derived_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a family of derived values; some matches have none."""
    first_blood = F.when(F.col("match_id") % 3 == 0, F.col("first_blood_time") / 60)
    return derive.with_derived(
        matches(spark, sf_dir, ("account_id", "leaver_status")),
        real_match=classify.real_match_status(),
        first_blood_minute=first_blood,
    )


def match_players(
    spark: SparkSession, sf_dir: str, player_fields: tuple[str, ...] = RECORD_FIELDS
) -> DataFrame:
    """One row per seat with its player fields, straight from the events."""
    columns = [f"{PLAYER_SQL[name]} AS {name}" for name in player_fields]
    return seats(spark, sf_dir).selectExpr("match_id", "pos", *columns)


def player_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of every non-anonymous player, one row per (account_id, ver_us)."""
    wide = matches(
        spark,
        sf_dir,
        ("ver_us", "ver_ms", "account_id", "hero_id", "player_slot", "leaver_status"),
    )
    return derive.player_timeline(wide, versions=("ver_us", "ver_ms"))


def _named_struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in fields.items()) + ")"


def _raw_items(ids: str) -> dict[str, str]:
    return {name: f"{ids}[{i}]" for i, name in enumerate(ITEM_FIELDS)}


def raw_match_lines(matches: DataFrame) -> DataFrame:
    """Raw JSON text of matches, one line per match, in column ``value``."""
    same = [
        "player_slot", "hero_id", "kills", "deaths", "assists", "leaver_status", "gold", "last_hits",
        "denies", "gold_spent", "hero_damage", "tower_damage", "hero_healing", "level",
    ]
    player = {
        "account_id": "IF(p.account_id < 0, p.account_id + 4294967296, p.account_id)",
        **{name: f"p.{name}" for name in same},
        "gold_per_min": "p.gold_per_minute",
        "xp_per_min": "p.exp_per_minute",
        **_raw_items("p.item_ids"),
        # No upgrades means no field.
        "ability_upgrades": "IF(size(p.ability_upgrades) > 0, transform(p.ability_upgrades, a -> "
        + _named_struct({"ability": "a.ability_id", "time": "a.time", "level": "a.level"})
        + "), NULL)",
    }
    unit = {"unitname": "p.additional_units.name", **_raw_items("p.additional_units.item_ids")}
    unit_json = f"to_json({_named_struct(unit)})"
    # The feed sometimes wraps the unit in a list.
    listed = f"IF(p.level = 5, concat('[', {unit_json}, ']'), {unit_json})"
    unit_field = f"IF(p.additional_units IS NULL, '', concat('\"additional_units\":', {listed}, ','))"
    rest_of_player = f"substring(to_json({_named_struct(player)}), 2)"
    player_text = f"concat('{{', {unit_field}, {rest_of_player})"
    players = f"array_join(transform(players, p -> {player_text}), ',')"
    match = {
        "season": "season",
        "radiant_win": "radiant_win",
        "duration": "duration",
        "start_time": "start_ms div 1000",
        "match_id": "match_id",
        "match_seq_num": "match_seq_num",
        "tower_status_radiant": "radiant_towers_status",
        "tower_status_dire": "dire_towers_status",
        "barracks_status_radiant": "radiant_barracks_status",
        "barracks_status_dire": "dire_barracks_status",
        "cluster": "cluster",
        "first_blood_time": "first_blood_time",
        "lobby_type": "lobby_type",
        "human_players": "human_players",
        "leagueid": "league_id",
        "positive_votes": "positive_votes",
        "negative_votes": "negative_votes",
        "game_mode": "game_mode",
    }
    rest = f"substring(to_json({_named_struct(match)}), 2)"
    return matches.selectExpr(f"concat('{{\"players\":[', {players}, '],', {rest}) AS value")


def corrupt_some(lines: DataFrame) -> DataFrame:
    """Lines of which some are cut to half, hold more text, hold two records, or are blank."""
    match_id = F.regexp_extract("value", r'"match_id":(\d+)', 1).cast("long")
    half = F.substring(F.col("value"), F.lit(1), F.expr("length(value) div 2"))
    value, kind = F.col("value"), match_id % 50
    damaged = F.when(kind == 49, half).when(kind == 48, F.concat(value, F.lit(" and more")))
    damaged = damaged.when(kind == 47, F.concat(value, value)).when(kind == 46, F.lit("  "))
    return lines.select(damaged.otherwise(value).alias("value"))


def corrupt_more(lines: DataFrame) -> DataFrame:
    """As ``corrupt_some``; some others are lists, two records in a row, or name a key twice."""
    match_id = F.regexp_extract("value", r'"match_id":(\d+)', 1).cast("long")
    value, kind = F.col("value"), match_id % 50
    damaged = F.when(kind == 45, F.concat(value, F.lit(","), value)).when(kind == 44, F.concat(F.lit("["), value, F.lit("]")))
    damaged = damaged.when(kind == 43, F.regexp_replace(value, "\\}$", ',"match_id":0}'))
    return corrupt_some(lines.select(damaged.otherwise(value).alias("value")))


def hero_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hero list as one JSON document."""
    heroes = match_players(spark, sf_dir, ("hero_id",)).select("hero_id").distinct()
    entry = F.struct(
        F.concat(F.lit("hero_"), "hero_id").alias("localized_name"),
        F.concat(F.lit("npc_hero_"), "hero_id").alias("name"),
        F.col("hero_id").alias("id"),
    )
    listed = heroes.agg(F.sort_array(F.collect_list(entry)).alias("heroes"))
    return listed.select(F.to_json(F.struct(F.size("heroes").alias("count"), "heroes")).alias("value"))


def hero_dimension(spark: SparkSession) -> DataFrame:
    """Hero names; hero 20 is left out on purpose."""
    return spark.range(1, 20).select(
        F.col("id").cast("int").alias("hero_id"), F.concat(F.lit("hero_"), "id").alias("name")
    )


def item_dimension(spark: SparkSession) -> DataFrame:
    return spark.range(0, 241).select(
        F.col("id").cast("int").alias("item_id"), F.concat(F.lit("item_"), "id").alias("name")
    )


def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of raw files by match-sequence range, with planted gaps and overlaps."""
    number = F.expr("event_id div 100")
    files = table(spark, sf_dir, "events").select(number.alias("f")).distinct()
    shift = F.when(F.col("f") % 9 == 4, 5).when(F.col("f") % 11 == 6, -7).otherwise(0)
    end = (F.col("f") + 1) * 30 + shift
    return files.select(
        F.concat(F.lit("matches_"), F.col("f") * 30, F.lit("-"), end, F.lit(".gz")).alias("file_name")
    )


def supply_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, vec, val, size): quantity each supplier sold of each brand."""
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("vec"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return (
        lines.join(brands, "l_partkey")
        .groupBy(F.col("l_suppkey").alias("index"), "vec")
        .agg(F.sum("l_quantity").cast("double").alias("val"), F.count("*").alias("size"))
    )
