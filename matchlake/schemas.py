"""Canonical schemas of the match, player and cell tables, and of the raw JSON."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


INT, LONG, DOUBLE, STRING, BOOLEAN = (
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.BooleanType(),
)

ABILITY_UPGRADE = _struct(("level", INT), ("ability_id", INT), ("time", INT))
ADDITIONAL_UNIT = _struct(("name", STRING), ("item_ids", T.ArrayType(INT)))

PLAYER = _struct(
    ("gold_spent", INT),
    ("gold", INT),
    ("deaths", INT),
    ("hero_damage", INT),
    ("last_hits", INT),
    ("player_slot", INT),
    ("denies", INT),
    ("ability_upgrades", T.ArrayType(ABILITY_UPGRADE)),
    ("tower_damage", INT),
    ("hero_id", INT),
    ("exp_per_minute", DOUBLE),
    ("account_id", INT),
    ("kills", INT),
    ("leaver_status", INT),
    ("hero_healing", INT),
    ("assists", INT),
    ("gold_per_minute", DOUBLE),
    ("level", INT),
    ("item_ids", T.ArrayType(INT)),
    ("additional_units", ADDITIONAL_UNIT),
)

MATCH_SCALARS = _struct(
    ("match_id", LONG),
    ("start_ms", LONG),
    ("dire_towers_status", INT),
    ("radiant_towers_status", INT),
    ("dire_barracks_status", INT),
    ("radiant_barracks_status", INT),
    ("cluster", INT),
    ("season", INT),
    ("game_mode", INT),
    ("match_seq_num", LONG),
    ("league_id", INT),
    ("first_blood_time", INT),
    ("negative_votes", INT),
    ("duration", INT),
    ("radiant_win", BOOLEAN),
    ("positive_votes", INT),
    ("lobby_type", INT),
    ("human_players", INT),
)

MATCHES = T.StructType(
    MATCH_SCALARS.fields
    + [
        T.StructField("players", T.ArrayType(PLAYER)),
        T.StructField("derived", T.MapType(STRING, DOUBLE)),
    ]
)

# Long form of every map-type family.
CELLS = _struct(("entity", LONG), ("qualifier", STRING), ("ts", LONG), ("value", DOUBLE))

# Sparse matrix entries: one row per (vec, index).
TRIPLES = _struct(("index", LONG), ("vec", INT), ("val", DOUBLE), ("size", LONG))

# Field names of the published raw records. ``additional_units`` is an object in
# some records and a list in others, so it is first read as a variant.
ITEM_FIELDS = [f"item_{i}" for i in range(6)]

RAW_UNIT = _struct(("unitname", STRING), *((name, INT) for name in ITEM_FIELDS))
RAW_ABILITY = _struct(("ability", INT), ("time", INT), ("level", INT))

RAW_PLAYER = _struct(
    ("account_id", LONG),
    ("player_slot", INT),
    ("hero_id", INT),
    *((name, INT) for name in ITEM_FIELDS),
    ("kills", INT),
    ("deaths", INT),
    ("assists", INT),
    ("leaver_status", INT),
    ("gold", INT),
    ("last_hits", INT),
    ("denies", INT),
    ("gold_per_min", DOUBLE),
    ("xp_per_min", DOUBLE),
    ("gold_spent", INT),
    ("hero_damage", INT),
    ("tower_damage", INT),
    ("hero_healing", INT),
    ("level", INT),
    ("ability_upgrades", T.ArrayType(RAW_ABILITY)),
    ("additional_units", T.VariantType()),
)

RAW_MATCH = _struct(
    ("players", T.ArrayType(RAW_PLAYER)),
    ("season", INT),
    ("radiant_win", BOOLEAN),
    ("duration", INT),
    ("start_time", LONG),
    ("match_id", LONG),
    ("match_seq_num", LONG),
    ("tower_status_radiant", INT),
    ("tower_status_dire", INT),
    ("barracks_status_radiant", INT),
    ("barracks_status_dire", INT),
    ("cluster", INT),
    ("first_blood_time", INT),
    ("lobby_type", INT),
    ("human_players", INT),
    ("leagueid", INT),
    ("positive_votes", INT),
    ("negative_votes", INT),
    ("game_mode", INT),
)


def narrow_raw_match(*player_fields: str) -> T.StructType:
    """Raw schema for jobs that need only the match id and a few player fields."""
    fields = [T.StructField("match_id", LONG)]
    if player_fields:
        wanted = [f for f in RAW_PLAYER.fields if f.name in player_fields]
        fields.append(T.StructField("players", T.ArrayType(T.StructType(wanted))))
    return T.StructType(fields)
