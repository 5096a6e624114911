"""Decoding of raw values as Column expressions (no joins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed


def non_anonymous(account_id: Column) -> Column:
    """True for a real account; never null."""
    return account_id.isNotNull() & (account_id != fixed.ANONYMOUS)


def signed_account_id(raw: Column) -> Column:
    """Unsigned 32-bit account id of the feed to the stored signed form."""
    return F.when(raw > 2147483647, raw - 4294967296).otherwise(raw).cast("int")


def team_slot(player_slot: Column) -> Column:
    """0-4 for the first to last Radiant player, 5-9 for the Dire."""
    dire = F.shiftright(player_slot, 7) == 1
    return F.when(dire, F.lit(5)).otherwise(F.lit(0)) + player_slot.bitwiseAND(7)


def is_radiant(player_slot: Column) -> Column:
    return F.shiftright(player_slot, 7) == 0


def won(player_slot: Column, radiant_win: Column) -> Column:
    return is_radiant(player_slot) == radiant_win


def flag(status: Column, bit: int) -> Column:
    return status.bitwiseAND(1 << bit) != 0


def tower_flags(status: Column) -> list[Column]:
    return [flag(status, i).alias(name) for i, name in enumerate(fixed.TOWERS)]


def towers_standing(status: Column) -> Column:
    return F.bit_count(status.bitwiseAND((1 << len(fixed.TOWERS)) - 1))


def barracks_flags(status: Column) -> list[Column]:
    return [flag(status, i).alias(name) for i, name in enumerate(fixed.BARRACKS)]


def barracks_standing(status: Column) -> Column:
    return F.bit_count(status)


def winner_barracks(radiant_win: Column, radiant: Column, dire: Column) -> Column:
    """Barracks the winning side still has."""
    return barracks_standing(F.when(radiant_win, radiant).otherwise(dire))


def _lookup(names: dict[int, str], key: Column) -> Column:
    """Name for a code from a handful of fixed entries; null when unknown."""
    entries = ", ".join(f"{code}, '{name}'" for code, name in names.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def game_mode_name(code: Column) -> Column:
    return _lookup(dict(enumerate(fixed.GAME_MODES)), code)


def game_mode_label(code: Column) -> Column:
    return _lookup({**dict(enumerate(fixed.GAME_MODES)), **fixed.GAME_MODE_LABELS}, code)


def lobby_type_name(code: Column) -> Column:
    return _lookup(dict(enumerate(fixed.LOBBY_TYPES, fixed.FIRST_LOBBY_TYPE)), code)


def leaver_status_name(code: Column) -> Column:
    """Null is a bot. Codes are positions, so the last two names sit at 5 and 6."""
    names = _lookup(dict(enumerate(fixed.LEAVER_STATUSES)), code)
    return F.when(code.isNull(), F.lit("BOT")).otherwise(names)


def item_slot_name(position: Column) -> Column:
    return _lookup(dict(enumerate(fixed.ITEM_SLOTS)), position)


def serious_game(game_mode: Column) -> Column:
    return game_mode.isin(*fixed.SERIOUS_GAME_MODES)


def serious_lobby(lobby_type: Column) -> Column:
    return lobby_type.isin(*fixed.SERIOUS_LOBBY_TYPES)
