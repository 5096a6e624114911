"""Fixed values of the game and of its data feed.

These must equal the published encodings, otherwise results differ.
"""

# Game modes by raw value 0..14.
GAME_MODES = [
    "UNKNOWN_ZERO",
    "ALL_PICK",
    "CAPTAINS_MODE",
    "RANDOM_DRAFT",
    "SINGLE_DRAFT",
    "ALL_RANDOM",
    "UNKOWN_SIX",
    "THE_DIRETIDE",
    "REVERSE_CAPTAINS_MODE",
    "GREEVILING",
    "TUTORIAL",
    "MID_ONLY",
    "LEAST_PLAYED",
    "NEW_PLAYER_POOL",
    "COMPENDIUM",
]

# Histogram labels name the two undocumented modes differently.
GAME_MODE_LABELS = {0: "GAME_MODE_ZERO", 6: "GAME_MODE_SIX"}

# Lobby types by raw value -1..6.
FIRST_LOBBY_TYPE = -1
LOBBY_TYPES = [
    "INVALID",
    "PUBLIC_MATCHMAKING",
    "PRACTICE",
    "TOURNAMENT",
    "TUTORIAL",
    "CO_OP_WITH_BOTS",
    "TEAM_MATCH",
    "SOLO_QUEUE",
]

# Leaver statuses by position; a missing status is a bot.
LEAVER_STATUSES = [
    "STAYED",
    "SAFE_LEAVE",
    "DISCONNECT_ABANDON",
    "ABANDON",
    "ABANDON_AND_RECONNECT",
    "UNKOWN_FIVE",
    "UNKNOWN_SIX",
    "BOT",
]

# Item slots by position 0..5.
ITEM_SLOTS = ["TOP_LEFT", "TOP_CENTER", "TOP_RIGHT", "BOT_RIGHT", "BOT_CENTER", "BOT_LEFT"]

# Tower flags by bit 0..10 of a towers status.
TOWERS = [
    "top_t1",
    "top_t2",
    "top_t3",
    "mid_t1",
    "mid_t2",
    "mid_t3",
    "bot_t1",
    "bot_t2",
    "bot_t3",
    "top_ancient",
    "bot_ancient",
]

# Barracks flags by bit 0..5 of a barracks status.
BARRACKS = ["top_melee", "top_ranged", "mid_melee", "mid_ranged", "bot_melee", "bot_ranged"]

# Match classification.
SERIOUS_GAME_MODES = [0, 1, 2, 3, 4, 5, 12, 14]
SERIOUS_LOBBY_TYPES = [0, 2, 5, 6]
FULL_MATCH_PLAYERS = 10
ALL_STAYED, SAFE_LEAVE, ABANDONED = 3.0, 2.0, 1.0
REAL_MATCH = 2.0

# Account ids: anonymous players as stored and in raw records.
ANONYMOUS = -1
RAW_ANONYMOUS = 4294967295
