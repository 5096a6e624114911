"""Raw JSON match lines to typed match and player tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed_values as fixed
from ..functions import values
from ..functions.slots import millis
from .classify import real_match_status

def _reason(line: Column, parsed: Column) -> Column:
    """Why a line is not one record, by what it parses to between brackets; null if it is one.

    A parser that reads a record leaves what follows it unread, and a blank line
    is an empty record to it. Between brackets both are something else than a list of one.
    """

    return (
        F.when(F.coalesce(F.trim(line), F.lit("")) == "", "blank")
        .when(parsed.isNull(), "not JSON")
        .when(~F.startswith(F.ltrim(line), F.lit("{")), "not a record")
        .when(F.try_variant_get(parsed, "$[1]", "variant").isNotNull(), "several records")
    )


def _each_line(lines: DataFrame, body: Callable[[Column, Column], Column], *kept: Column | str) -> DataFrame:
    """Rows of the structs that ``body`` makes of a line and its parsed form.

    A line is parsed once: as the variable of a lambda the parsed form is one value, and what is
    asked of the rows later stays above the generator.
    """
    bracketed = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    parsed = F.array(F.try_parse_json(bracketed))
    return lines.select(*kept, F.inline(F.flatten(F.transform(parsed, lambda v: body(F.col("value"), v)))))


def parse_lines(lines: DataFrame, schema: T.StructType = schemas.RAW_MATCH) -> DataFrame:
    """Typed records; a malformed line, or a value its field cannot hold, fails the job."""

    def body(line: Column, parsed: Column) -> Column:
        def row(reason: Column) -> Column:
            fault = F.raise_error(F.concat(F.lit("MALFORMED_LINE: "), reason))
            record = F.variant_get(parsed, "$[0]", schema.simpleString())
            return F.struct(F.when(reason.isNotNull(), fault).otherwise(record).alias("r"))

        return F.transform(F.array(_reason(line, parsed)), row)

    return _each_line(lines, body).select("r.*")


def sorted_out(lines: DataFrame, schema: T.StructType = schemas.RAW_MATCH, *kept: Column | str) -> DataFrame:
    """One row a line: ``reason``, null for a well-formed one, its record ``r``, else the ``line`` itself.

    Reasons are ``blank`` (null lines too), ``not JSON`` (cut off, followed by more, a key twice),
    ``not a record`` and ``several records``. Values are converted as by a cast, and one that its
    field cannot hold is null. ``kept`` columns of ``lines`` come first.
    """

    def body(line: Column, parsed: Column) -> Column:
        def row(reason: Column) -> Column:
            good = reason.isNull()
            record = F.when(good, F.try_variant_get(parsed, "$[0]", schema.simpleString()))
            return F.struct(reason.alias("reason"), record.alias("r"), F.when(~good, line).alias("line"))

        return F.transform(F.array(_reason(line, parsed)), row)

    return _each_line(lines, body, *kept)


def parse_good_lines(lines: DataFrame, schema: T.StructType = schemas.RAW_MATCH) -> DataFrame:
    """Typed records of the well-formed lines; malformed ones are left out."""
    return sorted_out(lines, schema).where(F.col("reason").isNull()).select("r.*")


def _reasons(lines: DataFrame, *kept: Column | str) -> DataFrame:
    def body(line: Column, parsed: Column) -> Column:
        row = lambda reason: F.struct(reason.alias("reason"), F.when(reason.isNotNull(), line).alias("line"))
        return F.transform(F.array(_reason(line, parsed)), row)

    return _each_line(lines, body, *kept)


def count_malformed(lines: DataFrame) -> DataFrame:
    """One row: how many lines are well-formed and how many are not."""
    return _reasons(lines).agg(
        F.count_if(F.col("reason").isNull()).alias("good_lines"),
        F.count_if(F.col("reason").isNotNull()).alias("malformed_lines"),
    )


def malformed(lines: DataFrame) -> DataFrame:
    """The malformed lines: ``file`` (empty if there is none), ``line`` and ``reason``."""
    rows = _reasons(lines, F.input_file_name().alias("file"))
    return rows.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def _items(record: Column) -> Column:
    return F.array(*(record[name] for name in schemas.ITEM_FIELDS))


def _first_unit(units: Column) -> Column:
    """Additional unit from an object or a list of objects."""
    kind = schemas.RAW_UNIT.simpleString()
    either = F.coalesce(F.try_variant_get(units, "$[0]", kind), F.try_variant_get(units, "$", kind))
    # Inside a lambda the unit is one value, however often its fields are read.
    unit = lambda u: F.when(u.isNotNull(), F.struct(u["unitname"].alias("name"), _items(u).alias("item_ids")))
    return F.get(F.transform(F.array(either), unit), F.lit(0))


def _player(raw: Column) -> Column:
    upgrades = F.transform(
        raw["ability_upgrades"],
        lambda a: F.struct(a["level"], a["ability"].alias("ability_id"), a["time"]),
    )
    none = F.array().cast(T.ArrayType(schemas.ABILITY_UPGRADE))
    special = {
        "ability_upgrades": F.coalesce(upgrades, none),
        "exp_per_minute": raw["xp_per_min"],
        "gold_per_minute": raw["gold_per_min"],
        "account_id": values.signed_account_id(raw["account_id"]),
        "item_ids": _items(raw),
        "additional_units": _first_unit(raw["additional_units"]),
    }
    fields = (special.get(f, raw[f]).alias(f) for f in schemas.PLAYER.fieldNames())
    return F.struct(*fields)


def to_matches(records: DataFrame, **kept: Column) -> DataFrame:
    """Raw records to the match table; the version is the start time in milliseconds. ``kept`` columns come first."""
    renamed = {
        "start_ms": millis(F.col("start_time")),
        "dire_towers_status": F.col("tower_status_dire"),
        "radiant_towers_status": F.col("tower_status_radiant"),
        "dire_barracks_status": F.col("barracks_status_dire"),
        "radiant_barracks_status": F.col("barracks_status_radiant"),
        "league_id": F.col("leagueid"),
    }
    scalars = (renamed.get(f, F.col(f)).alias(f) for f in schemas.MATCH_SCALARS.fieldNames())
    players = F.transform("players", _player).alias("players")
    return records.select(*[c.alias(n) for n, c in kept.items()], *scalars, players)


def ingest_matches(lines: DataFrame) -> DataFrame:
    """JSON lines to the match table: no shuffle, one row in, one row out."""
    return to_matches(parse_lines(lines))


def import_rows(lines: DataFrame) -> DataFrame:
    """Matches and malformed lines in one table: match columns, and ``file``, ``line`` and ``reason`` of the latter.

    ``good`` tells them apart; written by it, the table holds both in folders of their own
    after one pass over the lines.
    """
    rows = sorted_out(lines, schemas.RAW_MATCH, F.input_file_name().alias("file"))
    good = F.col("reason").isNull()
    flat = rows.select(good.alias("good"), F.when(~good, F.col("file")).alias("file"), "line", "reason", "r.*")
    kept = {"good": F.col("good"), "file": F.col("file"), "line": F.col("line"), "reason": F.col("reason")}
    return to_matches(flat, **kept)


def import_lines(lines: DataFrame, path: str) -> dict[str, int]:
    """Write matches and quarantine to ``path`` by ``good``; counts of the import's own pass.

    ``good_lines``, ``malformed_lines``, and how many matches have each ``real_match`` status,
    observed while the one scan of the lines is written.
    """
    seen = Observation("import")
    status = F.when(F.col("good"), real_match_status())
    statuses = {"abandoned": fixed.ABANDONED, "safe_leave": fixed.SAFE_LEAVE, "all_stayed": fixed.ALL_STAYED}
    rows = import_rows(lines).observe(
        seen,
        F.count_if("good").alias("good_lines"),
        F.count_if(~F.col("good")).alias("malformed_lines"),
        *[F.count_if(status == s).alias(n) for n, s in statuses.items()],
    )
    rows.write.mode("errorifexists").partitionBy("good").parquet(path)
    return dict(seen.get)


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The match table of an import."""
    table = spark.read.parquet(path).where("CAST(good AS BOOLEAN)")
    return table.drop("good", "file", "line", "reason")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines of an import: ``file``, ``line`` and ``reason``."""
    return spark.read.parquet(path).where("NOT CAST(good AS BOOLEAN)").select("file", "line", "reason")


def pivot_players(matches: DataFrame) -> DataFrame:
    """Match table to player table: one row per non-anonymous player.

    Each row holds the match's scalar columns, the player, and the other
    players in their original order. The version ``ts`` is the match start.
    """
    scalars = [f for f in schemas.MATCH_SCALARS.fieldNames() if f not in ("match_id", "start_ms")]
    seated = matches.select(
        "match_id", "start_ms", *scalars, "players", F.posexplode("players").alias("pos", "player")
    ).where(values.non_anonymous(F.col("player.account_id")))
    others = F.filter("players", lambda _, i: i != F.col("pos"))
    return seated.select(
        F.col("player.account_id").cast("long").alias("account_id"),
        F.col("start_ms").alias("ts"),
        "match_id",
        *scalars,
        "player",
        others.alias("other_players"),
    )


def ingest_player_matches(lines: DataFrame) -> DataFrame:
    return pivot_players(ingest_matches(lines))
