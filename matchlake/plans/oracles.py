"""The registered queries once more, as SQL over the same tables.

Written independently of the operators: flat joins and windows instead of
nested rows, and the plain definition instead of the scalable plan.
"""

from __future__ import annotations

from ..functions import fixed_values as fixed
from . import queries as q

_ITEMS = "[" + ", ".join(f"(k + {i * 37}) % 241" for i in range(6)) + "]"

_VIEWS = f"""
WITH e AS (
  SELECT event_id, event_id // 10 AS match_id, CAST(event_id % 10 AS INTEGER) AS pos,
         epoch_us(ts) AS ver_us, epoch_us(ts) // 1000 AS ver_ms,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, value AS v, user_id
  FROM events
),
mp AS (
  SELECT event_id, match_id, pos, ver_us, ver_ms, k, v,
    CAST(CASE WHEN pos < 5 THEN pos ELSE pos + 123 END AS INTEGER) AS player_slot,
    CAST(CASE WHEN user_id % 15 = 0 THEN -1 WHEN user_id % 50 = 7 THEN NULL ELSE user_id END AS INTEGER) AS account_id,
    CAST(k % 20 + 1 AS INTEGER) AS hero_id,
    CAST(CASE WHEN user_id % 50 = 7 THEN NULL WHEN k >= 98 THEN 2 WHEN k >= 93 THEN 1 ELSE 0 END AS INTEGER) AS leaver_status,
    CAST(k % 30 AS INTEGER) AS kills, CAST(event_id * 7 % 25 AS INTEGER) AS deaths,
    CAST(event_id * 3 % 40 AS INTEGER) AS assists, CAST(event_id * 5 % 50 AS INTEGER) AS denies,
    CAST(event_id * 13 % 400 AS INTEGER) AS last_hits,
    CAST(floor(v * 40) AS INTEGER) AS gold, CAST(floor(v * 100) AS INTEGER) AS gold_spent,
    CAST(floor(v * 200) AS INTEGER) AS hero_damage, CAST(floor(v * 10) AS INTEGER) AS hero_healing,
    CAST(floor(v * 30) AS INTEGER) AS tower_damage,
    CAST(CASE WHEN k = 77 THEN 26 ELSE 1 + k % 25 END AS INTEGER) AS level,
    v AS gold_per_minute, v * 1.5::DOUBLE AS exp_per_minute,
    {_ITEMS} AS item_ids,
    CASE WHEN k % 10 = 0 THEN 0 ELSE k % 5 + 1 END AS upgrades,
    k % 25 IN (3, 4) AS has_unit
  FROM e
),
mt AS (
  SELECT match_id, start_ms,
    CAST(match_id * 211 % 2048 AS INTEGER) AS dire_towers_status,
    CAST(match_id * 101 % 2048 AS INTEGER) AS radiant_towers_status,
    CAST(match_id * 53 % 64 AS INTEGER) AS dire_barracks_status,
    CAST(match_id * 37 % 64 AS INTEGER) AS radiant_barracks_status,
    CAST(111 + match_id % 10 AS INTEGER) AS cluster,
    CAST(CASE WHEN match_id % 10 = 0 THEN NULL ELSE match_id % 5 END AS INTEGER) AS season,
    CAST(CASE WHEN match_id % 97 = 0 THEN 99 ELSE match_id % 15 END AS INTEGER) AS game_mode,
    match_id * 3 + 1 AS match_seq_num,
    CAST(match_id % 7 AS INTEGER) AS league_id, CAST(match_id % 600 AS INTEGER) AS first_blood_time,
    CAST(match_id % 4 AS INTEGER) AS negative_votes,
    CAST(CASE WHEN match_id % 31 = 0 THEN -1 ELSE 600 + match_id % 3600 END AS INTEGER) AS duration,
    radiant_win, CAST(match_id % 6 AS INTEGER) AS positive_votes,
    CAST(match_id * 7 % 8 - 1 AS INTEGER) AS lobby_type,
    CAST(CASE WHEN match_id % 20 = 0 THEN 9 ELSE 10 END AS INTEGER) AS human_players
  FROM (SELECT match_id, min(ver_ms) AS start_ms, sum(k) % 2 = 0 AS radiant_win FROM e GROUP BY match_id)
),
leavers AS (
  SELECT match_id, bool_or(leaver_status IS NULL OR leaver_status >= 2) AS abandoned,
         bool_or(coalesce(leaver_status = 1, FALSE)) AS safe
  FROM mp GROUP BY match_id
),
serious AS (
  SELECT *, (game_mode < 6 OR game_mode IN (12, 14)) AS good_mode,
         lobby_type IN (0, 2, 5, 6) AS good_lobby, human_players = 10 AS is_full
  FROM mt JOIN leavers USING (match_id)
),
rm AS (
  SELECT match_id, CAST(CASE WHEN abandoned THEN 1 WHEN safe THEN 2 ELSE 3 END AS DOUBLE) AS real_match
  FROM serious WHERE good_mode AND good_lobby AND is_full
),
tl AS (
  SELECT CAST(account_id AS BIGINT) AS account_id, ver_us, ver_ms, mp.match_id, hero_id, player_slot,
         radiant_win, (player_slot < 128) = radiant_win AS win, real_match
  FROM mp JOIN mt ON mp.match_id = mt.match_id LEFT JOIN rm ON mp.match_id = rm.match_id
  WHERE account_id IS NOT NULL AND account_id <> -1
),
derived AS (
  SELECT match_id, 'real_match' AS qualifier, real_match AS value FROM rm
  UNION ALL
  SELECT match_id, 'first_blood_minute', first_blood_time / 60 FROM mt WHERE match_id % 3 = 0
),
moved AS (
  SELECT account_id, qualifier, start_ms AS ts, arg_max(value, d.match_id) AS value
  FROM (SELECT DISTINCT account_id, match_id FROM tl) t
  JOIN mt ON t.match_id = mt.match_id JOIN derived d ON t.match_id = d.match_id
  GROUP BY account_id, qualifier, start_ms
),
hero_dim AS (SELECT CAST(range AS INTEGER) AS hero_id, 'hero_' || range AS name FROM range(1, 20))
"""


def _tidy(expression: str) -> str:
    return f"CASE WHEN abs(round({expression}, 9)) = 0 THEN 0.0::DOUBLE ELSE round({expression}, 9) END"


def _case(code: str, names: dict[int, str]) -> str:
    branches = " ".join(f"WHEN {code} = {n} THEN '{name}'" for n, name in names.items())
    return f"CASE {branches} END"


_MODES = dict(enumerate(fixed.GAME_MODES))
_MODE_LABELS = {**_MODES, **fixed.GAME_MODE_LABELS}
_LOBBIES = dict(enumerate(fixed.LOBBY_TYPES, fixed.FIRST_LOBBY_TYPE))
_LEAVERS = dict(enumerate(fixed.LEAVER_STATUSES))
_SLOTS = dict(enumerate(fixed.ITEM_SLOTS))


def _rates(name: str, interval: int) -> str:
    return f"""{name} AS (
  SELECT hero_id, start_ms // {interval * 1000} * {interval * 1000} AS slot_ms,
         CAST(count(*) AS DOUBLE) AS games_played,
         avg(CASE WHEN (player_slot < 128) = radiant_win THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate
  FROM mp JOIN mt USING (match_id) JOIN rm USING (match_id)
  GROUP BY 1, 2
)"""


# For every radius the sums over its window, then the smallest radius that is enough.
_SLIDING = f"""
{_rates("slot_rates", q.SLOT)},
spans AS (
  SELECT hero_id, min(slot_ms) // {q.SLOT * q.STEP * 1000} * {q.SLOT * q.STEP * 1000} AS a, max(slot_ms) AS b
  FROM slot_rates GROUP BY hero_id
),
grid AS (
  SELECT hero_id, i, a + i * {q.SLOT * 1000} AS slot_ms, n
  FROM (SELECT hero_id, a, (b - a) // {q.SLOT * 1000} + 1 AS n,
               unnest(range(0, (b - a) // {q.SLOT * 1000} + 1)) AS i FROM spans)
),
filled AS (
  SELECT g.hero_id, g.i, g.slot_ms, g.n, coalesce(games_played, 0) AS games,
         coalesce(games_played * win_rate, 0) AS wins
  FROM grid g LEFT JOIN slot_rates r ON g.hero_id = r.hero_id AND g.slot_ms = r.slot_ms
),
tries AS (
  SELECT c.hero_id, c.i, c.slot_ms, r, sum(f.games) AS games, sum(f.wins) AS wins, count(*) AS width
  FROM (SELECT hero_id, i, slot_ms, unnest(range(0, n)) AS r FROM grid WHERE i % {q.STEP} = 0) c
  JOIN filled f ON f.hero_id = c.hero_id AND f.i BETWEEN c.i - c.r AND c.i + c.r
  GROUP BY c.hero_id, c.i, c.slot_ms, r
  HAVING sum(f.games) >= {q.SLOT_MIN_GAMES} AND count(*) >= {q.WINDOW}
),
smoothed AS (
  SELECT hero_id, slot_ms, arg_min(games, r) AS games_played, arg_min(wins / games, r) AS win_rate
  FROM tries GROUP BY hero_id, slot_ms
)"""

_LATE_GAMES = f"""late AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ver_us) AS game_no
    FROM tl WHERE real_match >= 2
  ) WHERE game_no > {q.DROP_FIRST}
)"""

_RAW_SKILL = f"""{_LATE_GAMES},
skill AS (
  SELECT account_id, hero_id, avg(CASE WHEN win THEN 1.0::DOUBLE ELSE 0.0 END) AS score, count(*) AS size
  FROM late GROUP BY account_id, hero_id HAVING count(*) >= {q.MIN_GAMES}
)"""


def _adjusted(rates: str) -> str:
    day = q.DAY * 1000
    return f"""{_LATE_GAMES},
skill AS (
  SELECT l.account_id, l.hero_id,
         avg(CASE WHEN win THEN 1.0::DOUBLE ELSE 0.0 END - win_rate) AS score, count(*) AS size
  FROM late l
  JOIN (SELECT account_id, hero_id FROM late GROUP BY 1, 2 HAVING count(*) >= {q.MIN_GAMES}) m
    ON l.account_id = m.account_id AND l.hero_id = m.hero_id
  JOIN {rates} r ON l.hero_id = r.hero_id AND l.ver_ms // {day} * {day} = r.slot_ms
  GROUP BY l.account_id, l.hero_id
)"""


def _shared(triples: str, size_filter: int) -> str:
    """Pearson over shared indexes; null where a side is constant."""
    return f"""shared AS (
  SELECT a.vec AS vec, b.vec AS vec2, count(*) AS size,
         CASE WHEN min(a.val) = max(a.val) OR min(b.val) = max(b.val) THEN NULL
              ELSE covar_pop(a.val, b.val) / (stddev_pop(a.val) * stddev_pop(b.val)) END AS cor
  FROM (SELECT * FROM {triples} WHERE size > {size_filter}) a
  JOIN (SELECT * FROM {triples} WHERE size > {size_filter}) b ON a.index = b.index AND a.vec < b.vec
  GROUP BY a.vec, b.vec
)"""


_SKILL_TRIPLES = "(SELECT account_id AS index, hero_id AS vec, score AS val, size FROM skill)"

_PICKS = f"""picks AS (
  SELECT account_id AS index, hero_id AS vec, CAST(count(*) AS DOUBLE) AS val
  FROM tl
  WHERE real_match IS NOT NULL AND account_id IN (
    SELECT account_id FROM tl WHERE real_match IS NOT NULL GROUP BY 1 HAVING count(*) > {q.PICK_SIZE})
  GROUP BY 1, 2
),
n AS (SELECT CAST(count(DISTINCT account_id) AS DOUBLE) AS n FROM tl),
vecs AS (SELECT DISTINCT vec FROM picks),
sums AS (SELECT vec, sum(val) AS s, sum(val * val) AS ss FROM picks GROUP BY vec),
dots AS (
  SELECT a.vec AS vec1, b.vec AS vec2, sum(a.val * b.val) AS p
  FROM picks a JOIN picks b ON a.index = b.index AND a.vec > b.vec GROUP BY 1, 2
)"""

_PICK_PEARSON = _tidy(
    "(n * coalesce(p, 0) - x.s * y.s) / nullif(sqrt(n * x.ss - x.s * x.s) * sqrt(n * y.ss - y.s * y.s), 0)"
)

_ROWS = f"""rows AS (
  SELECT account_id, CAST(row_number() OVER (ORDER BY account_id) - 1 AS DOUBLE) AS row_number
  FROM tl WHERE real_match IS NOT NULL GROUP BY account_id HAVING count(*) >= {q.ROW_SIZE}
)"""

_SHARES = f"""{_ROWS},
shares AS (
  SELECT CAST(row_number AS BIGINT) AS player_row, hero_id,
         count(*) / sum(count(*)) OVER (PARTITION BY t.account_id) AS share
  FROM tl t JOIN rows r ON t.account_id = r.account_id
  WHERE real_match IS NOT NULL GROUP BY t.account_id, row_number, hero_id
)"""


def _kmeans() -> str:
    """Lloyd steps over dense vectors."""
    parts = [
        "heroes AS (SELECT DISTINCT hero_id FROM shares)",
        "dims AS (SELECT DISTINCT player_row FROM shares)",
        "dense AS (SELECT h.hero_id, d.player_row, CAST(round(coalesce(s.share, 0) * 1e12) AS HUGEINT) AS x"
        " FROM heroes h CROSS JOIN dims d"
        " LEFT JOIN shares s ON s.hero_id = h.hero_id AND s.player_row = d.player_row)",
        "seeds AS (SELECT hero_id, row_number() OVER (ORDER BY hero_id) - 1 AS cluster FROM heroes"
        f" QUALIFY cluster < {q.CLUSTERS})",
        "c0 AS (SELECT cluster, player_row, x AS c, 1 AS m FROM dense JOIN seeds USING (hero_id))",
    ]
    for i in range(q.ITERATIONS + 1):
        parts.append(
            f"d{i} AS (SELECT hero_id, cluster, sum(abs(m * x - c)) * 1000000 // any_value(m) AS d"
            f" FROM dense JOIN c{i} USING (player_row)"
            " GROUP BY hero_id, cluster)"
        )
        parts.append(
            f"a{i} AS (SELECT hero_id, cluster FROM d{i}"
            " QUALIFY row_number() OVER (PARTITION BY hero_id ORDER BY d, cluster) = 1)"
        )
        parts.append(
            f"c{i + 1} AS (SELECT cluster, player_row, sum(x) AS c, count(*) AS m FROM dense JOIN a{i} USING (hero_id)"
            f" GROUP BY cluster, player_row UNION ALL SELECT * FROM c{i}"
            f" WHERE cluster NOT IN (SELECT cluster FROM a{i}))"
        )
    return ",\n".join(parts)


_STREAKS = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ver_us) AS game_no FROM tl
),
reals AS (
  SELECT *, row_number() OVER w AS real_no, lag(win) OVER w AS previous
  FROM numbered WHERE real_match >= 2 WINDOW w AS (PARTITION BY account_id ORDER BY ver_us)
),
islands AS (
  SELECT *, sum(CASE WHEN previous IS NULL OR previous <> win THEN 1 ELSE 0 END)
    OVER (PARTITION BY account_id ORDER BY ver_us) AS island FROM reals
),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, island ORDER BY ver_us) AS run FROM islands
),
streaks AS (
  SELECT account_id, ver_us, win, game_no, real_no,
    CAST(coalesce(lag(CASE WHEN win THEN run ELSE -run END)
      OVER (PARTITION BY account_id ORDER BY ver_us), 0) AS INTEGER) AS streak
  FROM runs
)"""

_WON = "CASE WHEN win THEN 1.0::DOUBLE ELSE 0.0 END"
_DAY = q.DAY * 1000

_FIELDS = f"""cells AS (
  SELECT 'game_mode' AS field, CAST(game_mode AS VARCHAR) AS value, start_ms FROM mt
  UNION ALL SELECT 'lobby_type', CAST(lobby_type AS VARCHAR), start_ms FROM mt
),
counts AS (
  SELECT field, value, start_ms // {_DAY} * {_DAY} AS "start", start_ms // {_DAY} * {_DAY} + {_DAY} AS "end",
         count(*) AS "count"
  FROM cells GROUP BY 1, 2, 3, 4
)"""

_WEEK = 7 * 24 * 60 * 60
_WEEKLY = f"""{_FIELDS},
dated AS (SELECT field, value, "start" // 1000 AS s, "count" FROM counts WHERE "start" <> 0),
edges AS (SELECT field, min(s) AS a, max(s) AS b FROM dated GROUP BY field),
weeks AS (SELECT field, a, unnest(range(a, b, {_WEEK})) AS bin FROM edges),
weekly AS (
  SELECT w.field,
    coalesce(CASE WHEN w.field = 'game_mode' THEN {_case("CAST(v.value AS INTEGER)", _MODE_LABELS)}
                  WHEN w.field = 'lobby_type' THEN {_case("CAST(v.value AS INTEGER)", _LOBBIES)} END,
             v.value) AS value,
    bin * 1000 AS bin_ms,
    CAST(coalesce(sum(d."count"), 0) AS BIGINT) AS "count"
  FROM weeks w JOIN (SELECT DISTINCT field, value FROM dated) v ON w.field = v.field
  LEFT JOIN dated d ON d.field = v.field AND d.value = v.value AND d.s >= w.bin AND d.s < w.bin + {_WEEK}
  GROUP BY w.field, v.value, bin
)"""


def _rule(value: str, name: str, low: int, high: int) -> str:
    return (
        f"WHEN {value} IS NULL THEN '{name} was null' "
        f"WHEN {value} < {low} THEN '{name} was smaller then {low}' "
        f"WHEN {value} > {high} THEN '{name} was larger then {high}' "
    )


_MATCH_RULES = (
    _rule("start_ms", "start_time", 1104537600000, q.AS_OF_MS + 60000)
    + "".join(_rule(f"{s}_towers_status", f"{s}_tower_status", 0, 2048) for s in ("dire", "radiant"))
    + "".join(_rule(f"{s}_barracks_status", f"{s}_barracks_status", 0, 64) for s in ("dire", "radiant"))
    + _rule("human_players", "human_players", 0, 10)
    + "WHEN lobby_type IS NULL OR lobby_type NOT BETWEEN -1 AND 6 THEN 'lobby_type unknown' "
    + "WHEN game_mode IS NULL OR game_mode NOT BETWEEN 0 AND 14 THEN 'game_mode unknown' "
    + "".join(
        _rule(c, c, 0, 1073741823)
        for c in ("cluster", "season", "duration", "negative_votes", "positive_votes")
    )
    + _rule("league_id", "league_id", 0, 2147483647)
)

_PLAYER_RULES = (
    "WHEN account_id < -1 THEN 'account_id was smaller then 0' "
    + "WHEN leaver_status NOT BETWEEN 0 AND 7 THEN 'leaver_status unknown' "
    + _rule("assists", "assists", 0, 1000)
    + _rule("deaths", "deaths", 0, 1000)
    + _rule("denies", "denies", 0, 5000)
    + _rule("gold", "gold", 0, 10000)
    + _rule("gold_spent", "gold_spent", 0, 1000000)
    + _rule("hero_damage", "hero_damage", 0, 214748364)
    + _rule("hero_healing", "hero_healing", 0, 214748364)
    + _rule("hero_id", "hero_id", 0, 200)
    + _rule("kills", "kills", 0, 1000)
    + _rule("last_hits", "last_hits", 0, 10000)
    + _rule("player_slot", "player_slot", 0, 256)
    + _rule("level", "level", 0, 25)
    + _rule("gold_per_minute", "gold_per_minute", 0, 200000)
    + _rule("exp_per_minute", "exp_per_minute", 0, 200000)
    + _rule("upgrades", "ability upgrade size", 0, 25)
)

_SCALARS = (
    "mt.match_id, start_ms // 1000 * 1000 AS start_ms, dire_towers_status, radiant_towers_status, "
    "dire_barracks_status, radiant_barracks_status, cluster, season, game_mode, match_seq_num, league_id, "
    "first_blood_time, negative_votes, duration, radiant_win, positive_votes, lobby_type, human_players"
)

_UPGRADE_TEXT = (
    "array_to_string(list_transform(range(1, upgrades + 1), lambda i: "
    "i || ':' || (5000 + i) || ':' || (60 * i)), ',')"
)

_ID_TEXT = "coalesce(CAST({c} AS VARCHAR), 'null')"


def _others(column: str) -> str:
    return (
        f"array_to_string(list({_ID_TEXT.format(c='o.' + column)} ORDER BY o.pos), ',')"
    )


def _flags(side: str) -> str:
    towers = ", ".join(
        f"({side}_towers_status >> {i}) & 1 = 1 AS {side}_{name}" for i, name in enumerate(fixed.TOWERS)
    )
    barracks = ", ".join(
        f"({side}_barracks_status >> {i}) & 1 = 1 AS {side}_{name}"
        for i, name in enumerate(fixed.BARRACKS)
    )
    return (
        f"{towers}, CAST(bit_count({side}_towers_status & 2047) AS INTEGER) AS {side}_towers_standing, "
        f"{barracks}, CAST(bit_count({side}_barracks_status) AS INTEGER) AS {side}_barracks_standing"
    )


_UPSERT = f"""
SELECT account_id AS entity, qualifier, ts, {_tidy('arg_max(value, (put, value))')} AS value
FROM (
  SELECT account_id, qualifier, ts, value, 0 AS put FROM moved
  UNION ALL
  SELECT account_id, qualifier, CASE WHEN account_id % 2 = 1 THEN ts ELSE ts + 1 END, value + 10, 1
  FROM moved WHERE qualifier = 'real_match'
) GROUP BY account_id, qualifier, ts"""

_BODIES: dict[str, str] = {
    # ingest
    "ingest_matches": f"""
SELECT {_SCALARS}, pos, gold_spent, gold, deaths, hero_damage, last_hits, player_slot, denies, tower_damage,
  hero_id, exp_per_minute, account_id, kills, leaver_status, hero_healing, assists, gold_per_minute, level,
  {_UPGRADE_TEXT} AS ability_upgrades,
  array_to_string(item_ids, ',') AS item_ids,
  CASE WHEN has_unit THEN 'spirit_bear' END AS unit_name,
  CASE WHEN has_unit THEN array_to_string(item_ids, ',') END AS unit_item_ids
FROM mt JOIN mp USING (match_id)""",
    "ingest_player_matches": f"""
SELECT CAST(p.account_id AS BIGINT) AS account_id, start_ms // 1000 * 1000 AS ts, p.match_id, game_mode,
  lobby_type, season, radiant_win, duration, p.hero_id, p.player_slot, p.gold,
  CAST(count(*) AS INTEGER) AS others, {_others("account_id")} AS other_accounts,
  {_others("hero_id")} AS other_heroes
FROM mp p JOIN mt ON p.match_id = mt.match_id JOIN mp o ON o.match_id = p.match_id AND o.pos <> p.pos
WHERE p.account_id IS NOT NULL AND p.account_id <> -1
GROUP BY p.account_id, start_ms, p.match_id, p.pos, game_mode, lobby_type, season, radiant_win, duration,
  p.hero_id, p.player_slot, p.gold""",
    "tolerant_ingest": """
SELECT mt.match_id, game_mode, CAST(count(*) AS INTEGER) AS players
FROM mt JOIN mp USING (match_id) WHERE mt.match_id % 50 < 46 GROUP BY mt.match_id, game_mode""",
    "malformed_lines": """
SELECT count(*) FILTER (match_id % 50 < 46) AS good_lines, count(*) FILTER (match_id % 50 >= 46) AS malformed_lines
FROM mt""",
    "quarantined_lines": """
SELECT CASE WHEN match_id % 50 NOT IN (46, 49) THEN match_id END AS match_id,
  CASE match_id % 50 WHEN 46 THEN 'blank' WHEN 45 THEN 'several records' WHEN 44 THEN 'not a record' ELSE 'not JSON' END AS reason
FROM mt WHERE match_id % 50 >= 43""",
    "hero_names": "SELECT DISTINCT hero_id, 'hero_' || hero_id AS name FROM mp",
    # classification and derived values
    "real_match": "SELECT match_id, CAST(0 AS BIGINT) AS ts, real_match FROM rm",
    "real_match_counters": """
SELECT count(*) FILTER (good_mode AND good_lobby AND is_full) AS good_matches,
  count(*) FILTER (NOT good_mode) AS bad_game_mode, count(*) FILTER (NOT good_lobby) AS bad_lobby,
  count(*) FILTER (abandoned) AS leavers, count(*) FILTER (safe AND NOT abandoned) AS safe_leavers,
  count(*) FILTER (abandoned AND good_mode AND good_lobby AND is_full) AS real_match_with_leavers,
  count(*) FILTER (safe AND NOT abandoned AND good_mode AND good_lobby AND is_full)
    AS real_match_with_safe_leavers,
  count(*) FILTER (NOT (good_mode AND good_lobby AND is_full)) AS bad_matches,
  count(*) FILTER (NOT is_full) AS under_ten_players
FROM serious""",
    "transfer_derived": f"SELECT account_id, qualifier, ts, {_tidy('value')} AS value FROM moved",
    "transfer_derived_matching": """
SELECT account_id, qualifier, ts, value FROM moved WHERE regexp_full_match(qualifier, 'real_.*')""",
    "games_played": """
SELECT account_id, CAST(0 AS BIGINT) AS ts, CAST(count(*) FILTER (real_match <> 1) AS DOUBLE) AS games_played
FROM tl WHERE real_match IS NOT NULL GROUP BY account_id""",
    "advanced_games_played": """
SELECT account_id, CAST(0 AS BIGINT) AS ts, CAST(count(*) FILTER (real_match <> 1) AS DOUBLE) AS games_played
FROM tl WHERE real_match IS NOT NULL GROUP BY account_id""",
    # versioned cells
    "match_cells": f"""
SELECT match_id AS entity, qualifier, start_ms AS ts, {_tidy('value')} AS value
FROM derived JOIN mt USING (match_id)""",
    "latest_cells": f"""
SELECT account_id AS entity, qualifier, max(ts) AS ts, {_tidy('arg_max(value, ts)')} AS value
FROM moved GROUP BY account_id, qualifier""",
    "upsert_cells": _UPSERT,
    "stored_cells": _UPSERT,
    "hero_cells": f"""
, {_rates("r", q.DAY)}
SELECT CAST(hero_id AS BIGINT) AS entity, 'games_played_{q.DAY}' AS qualifier, slot_ms AS ts,
       games_played AS value FROM r
UNION ALL
SELECT CAST(hero_id AS BIGINT), 'win_rate_{q.DAY}', slot_ms, {_tidy('win_rate')} FROM r""",
    "sliding_cells": f"""
, {_SLIDING}
SELECT CAST(hero_id AS BIGINT) AS entity, 'games_played_average_{q.SLOT * q.STEP}' AS qualifier, slot_ms AS ts,
       games_played AS value FROM smoothed
UNION ALL
SELECT CAST(hero_id AS BIGINT), 'win_rate_average_{q.SLOT * q.STEP}', slot_ms, {_tidy('win_rate')} FROM smoothed""",
    "row_number_cells": f"""
, {_ROWS}
SELECT account_id AS entity, 'row_number_{q.ROW_SIZE}' AS qualifier, CAST(0 AS BIGINT) AS ts, row_number AS value
FROM rows""",
    # hero statistics and skill
    "hero_win_rates": f"""
, {_rates("r", q.SLOT)}
SELECT hero_id, slot_ms, games_played, {_tidy('win_rate')} AS win_rate FROM r""",
    "sliding_hero_win_rates": f"""
, {_SLIDING}
SELECT hero_id, slot_ms, games_played, {_tidy('win_rate')} AS win_rate FROM smoothed""",
    "hero_skill_raw": f"""
, {_RAW_SKILL}
SELECT account_id, hero_id, {_tidy('score')} AS score, size FROM skill""",
    "hero_skill_adjusted": f"""
, {_rates("day_rates", q.DAY)}, {_adjusted("day_rates")}
SELECT account_id, hero_id, {_tidy('score')} AS score, size FROM skill""",
    # correlations
    "tuple_correlations": f"""
, {_RAW_SKILL}, {_shared(_SKILL_TRIPLES, 0)}
SELECT vec, vec2, {_tidy('cor')} AS cor, size FROM shared""",
    "pick_correlations": f"""
, {_PICKS}
SELECT CAST(i.range AS INTEGER) AS vec1, CAST(j.range AS INTEGER) AS vec2, {_PICK_PEARSON} AS cor
FROM range({q.FIRST_HERO}, {q.LAST_HERO + 1}) i JOIN range({q.FIRST_HERO}, {q.LAST_HERO + 1}) j
  ON i.range > j.range
CROSS JOIN n LEFT JOIN (SELECT vec, s, ss FROM sums) x ON x.vec = i.range
LEFT JOIN (SELECT vec, s, ss FROM sums) y ON y.vec = j.range
LEFT JOIN dots ON dots.vec1 = i.range AND dots.vec2 = j.range
WHERE x.vec IS NOT NULL OR y.vec IS NOT NULL""",
    "inmem_correlations": f"""
, {_PICKS}
SELECT x.vec AS vec1, y.vec AS vec2, {_PICK_PEARSON} AS cor
FROM sums x JOIN sums y ON x.vec > y.vec CROSS JOIN n
LEFT JOIN dots ON dots.vec1 = x.vec AND dots.vec2 = y.vec""",
    "matrix_correlations": f"""
, {_PICKS},
means AS (SELECT vec, sum(val) / max(n) AS mean FROM picks CROSS JOIN n GROUP BY vec),
deviations AS (
  SELECT vec, max(mean) AS mean, sqrt(sum((val - mean) * (val - mean)) / max(n)) AS deviation
  FROM picks JOIN means USING (vec) CROSS JOIN n GROUP BY vec
),
normal AS (SELECT index, vec, (val - mean) / nullif(deviation, 0) AS z FROM picks JOIN deviations USING (vec))
SELECT a.vec AS vec1, b.vec AS vec2, {_tidy('sum(a.z * b.z) / max(n)')} AS cor
FROM normal a JOIN normal b ON a.index = b.index AND a.vec > b.vec CROSS JOIN n GROUP BY a.vec, b.vec""",
    "named_correlations": f"""
, {_RAW_SKILL}, {_shared(_SKILL_TRIPLES, 0)}
SELECT coalesce(h.name, 'UNKNOWN') AS hero, coalesce(g.name, 'UNKNOWN') AS hero2, {_tidy('cor')} AS cor, size
FROM shared LEFT JOIN hero_dim h ON h.hero_id = vec LEFT JOIN hero_dim g ON g.hero_id = vec2
WHERE cor IS NOT NULL AND size > 4""",
    "supply_correlations": f"""
, triples AS (
  SELECT l_suppkey AS index, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS vec,
         CAST(sum(l_quantity) AS DOUBLE) AS val, count(*) AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), {_shared("triples", 1)}
SELECT vec, vec2, {_tidy('cor')} AS cor, size FROM shared""",
    "skill_correlation_chain": f"""
, {_SLIDING}, {_adjusted("smoothed")}, {_shared(_SKILL_TRIPLES, 0)}
SELECT coalesce(h.name, 'UNKNOWN') AS hero, coalesce(g.name, 'UNKNOWN') AS hero2, {_tidy('cor')} AS cor, size
FROM shared LEFT JOIN hero_dim h ON h.hero_id = vec LEFT JOIN hero_dim g ON g.hero_id = vec2
WHERE cor IS NOT NULL""",
    # picks and clusters
    "hero_pick_share": f"""
, {_SHARES}
SELECT player_row, hero_id, {_tidy('share')} AS share FROM shares""",
    "player_row_numbers": f", {_ROWS} SELECT account_id, row_number FROM rows",
    "pick_vectors": f"""
, {_SHARES}
SELECT hero_id, player_row // 65536 AS block, CAST(count(*) AS INTEGER) AS entries,
  array_to_string(list(player_row ORDER BY player_row), ',') AS indices,
  array_to_string(list(round(share, 9) ORDER BY player_row), ',') AS shares
FROM shares GROUP BY hero_id, player_row // 65536""",
    "hero_clusters": f"""
, {_SHARES}, {_kmeans()}
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS members,
  array_to_string(list(coalesce(name, 'UNKNOWN') ORDER BY coalesce(name, 'UNKNOWN')), ', ') AS heroes
FROM a{q.ITERATIONS} LEFT JOIN hero_dim USING (hero_id) GROUP BY cluster""",
    # timelines
    "streak_values": f", {_STREAKS} SELECT account_id, ver_us, streak FROM streaks WHERE real_no > {q.BURN_IN}",
    "advanced_streak_values": f", {_STREAKS} SELECT account_id, ver_us, streak FROM streaks WHERE real_no > {q.BURN_IN}",
    "streak_win_rate": f"""
, {_STREAKS}
SELECT streak, {_tidy(f'avg({_WON})')} AS win_rate, count(*) AS games
FROM streaks WHERE game_no > {q.BURN_IN} GROUP BY streak""",
    "win_rate_vs_games": f"""
, windows AS (
  SELECT row_number() OVER (PARTITION BY account_id ORDER BY ver_us) AS window_no,
    count(*) OVER ahead AS games, avg({_WON}) OVER ahead AS rate
  FROM tl WHERE real_match >= 2
  WINDOW ahead AS (PARTITION BY account_id ORDER BY ver_us
                   ROWS BETWEEN CURRENT ROW AND {q.GAMES_WINDOW - 1} FOLLOWING)
)
SELECT window_no, count(*) AS size, {_tidy('avg(rate)')} AS mean, {_tidy('stddev_pop(rate)')} AS stdev
FROM windows WHERE games = {q.GAMES_WINDOW} OR window_no = 1 GROUP BY window_no""",
    "group_win_rate": f"""
SELECT real_match, count(*) AS size, {_tidy(f'avg({_WON})')} AS mean, {_tidy(f'stddev_pop({_WON})')} AS stdev
FROM tl WHERE real_match IS NOT NULL GROUP BY real_match""",
    # histograms
    "winner_rax_counts": """
SELECT CAST(bit_count(CASE WHEN radiant_win THEN radiant_barracks_status ELSE dire_barracks_status END) AS INTEGER)
         AS raxes_left, count(*) AS games_won
FROM mt JOIN rm USING (match_id) WHERE real_match >= 2 GROUP BY 1""",
    "winner_rax_percent": f"""
, rax AS (
  SELECT CAST(bit_count(CASE WHEN radiant_win THEN radiant_barracks_status ELSE dire_barracks_status END) AS INTEGER)
           AS raxes_left
  FROM mt JOIN rm USING (match_id) WHERE real_match >= 2
)
SELECT raxes_left, count(*) AS games_won, {_tidy('count(*) / (SELECT count(*) FROM rax)')} AS percent
FROM rax GROUP BY ROLLUP (raxes_left)""",
    "value_histogram": f"""
SELECT CAST(game_mode AS VARCHAR) AS value,
  (start_ms // {_DAY} * {_DAY}) || '-' || (start_ms // {_DAY} * {_DAY} + {_DAY}) AS slot, count(*) AS "count"
FROM mt GROUP BY 1, 2""",
    "multi_histogram": f', {_FIELDS} SELECT field, value, "start", "end", "count" FROM counts',
    "value_histogram_nulls": """
, keyed AS (
  SELECT 'data:game_mode=' || coalesce(CAST(game_mode AS VARCHAR), 'NULL') || ' [' ||
         (start_ms // 21600000 * 21600000) || '-' || (start_ms // 21600000 * 21600000 + 21600000) || ')' AS key FROM mt
  UNION ALL
  SELECT 'data:season=' || coalesce(CAST(season AS VARCHAR), 'NULL') || ' [' ||
         (start_ms // 21600000 * 21600000) || '-' || (start_ms // 21600000 * 21600000 + 21600000) || ')' FROM mt
  UNION ALL
  SELECT 'data:season=' || coalesce(CAST(season AS VARCHAR), 'NULL') FROM mt
)
SELECT key, count(*) AS "count" FROM keyed GROUP BY key""",
    "weekly_histogram": f', {_WEEKLY} SELECT field, value, bin_ms, "count" FROM weekly',
    "weekly_histogram_wide": f"""
, {_WEEKLY},
one AS (
  SELECT value, strftime(make_timestamp(bin_ms * 1000), '%m-%d-%Y') AS date, "count"
  FROM weekly WHERE field = 'game_mode'
)
SELECT value, date, CAST(sum("count") AS BIGINT) AS "count" FROM one GROUP BY value, date""",
    # integrity checks
    "validate_matches": f"""
, player_faults AS (
  SELECT match_id, pos, CASE {_PLAYER_RULES} END AS message FROM mp
),
first_player AS (
  SELECT match_id, arg_min(message, pos) AS message FROM player_faults WHERE message IS NOT NULL GROUP BY match_id
),
faults AS (
  SELECT CASE {_MATCH_RULES} ELSE f.message END AS message
  FROM mt LEFT JOIN first_player f ON f.match_id = mt.match_id
)
SELECT message, count(*) AS matches FROM faults WHERE message IS NOT NULL GROUP BY message""",
    "compare_match_ids": """
, stored AS (
  SELECT match_id FROM mt WHERE match_id % 40 <> 0
  UNION ALL SELECT match_id + 1000000 FROM mt WHERE match_id % 60 = 0
  UNION ALL SELECT NULL FROM mt WHERE match_id % 70 = 0
),
known AS (SELECT CASE WHEN match_id % 90 <> 1 THEN match_id END AS match_id FROM mt)
SELECT a.match_id AS record_match_id, b.match_id AS table_match_id
FROM known a FULL OUTER JOIN stored b ON a.match_id = b.match_id
WHERE a.match_id IS NULL OR b.match_id IS NULL""",
    "compare_player_counts": """
, known AS (SELECT account_id, event_id FROM mp WHERE account_id IS NOT NULL AND account_id <> -1),
a AS (SELECT account_id, count(*) AS n FROM known GROUP BY account_id),
b AS (SELECT account_id, count(*) AS n FROM known WHERE event_id % 45 <> 0 GROUP BY account_id)
SELECT CAST(coalesce(a.account_id, b.account_id) AS BIGINT) AS account_id,
  a.n AS record_matches, b.n AS table_matches
FROM a FULL OUTER JOIN b ON a.account_id = b.account_id WHERE a.n IS DISTINCT FROM b.n""",
    "count_unique_match_ids": "SELECT count(DISTINCT match_id) AS match_ids FROM mt",
    "count_lines": "SELECT count(*) AS lines FROM mt",
    "count_cells": "SELECT count(real_match) AS cells FROM tl",
    "matches_for_player": "SELECT DISTINCT match_id FROM mp WHERE account_id = 1",
    "max_account_id": """
SELECT CAST(max(account_id) AS BIGINT) AS max_account_id FROM mp WHERE account_id <> -1 AND match_id % 50 < 46""",
    "example_values": """
, firsts AS (
  SELECT coalesce(CAST(leaver_status AS VARCHAR), 'null') AS value, match_id, min(pos) AS pos
  FROM mp GROUP BY 1, 2
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY value ORDER BY match_id) AS n FROM firsts QUALIFY n <= 10
)
SELECT value, count(*) AS examples,
  array_to_string(list('Match: ' || match_id || ' player: ' ||
    CASE WHEN pos < 5 THEN pos ELSE pos + 123 END || ' (' || pos || ')' ORDER BY n), chr(10)) AS summary
FROM ranked GROUP BY value""",
    "sequence_gaps": """
, files AS (
  SELECT f * 30 AS a, (f + 1) * 30 + CASE WHEN f % 9 = 4 THEN 5 WHEN f % 11 = 6 THEN -7 ELSE 0 END AS b
  FROM (SELECT DISTINCT match_id // 10 AS f FROM mt)
),
pairs AS (SELECT lag(b) OVER (ORDER BY a, b) AS previous_end, a AS next_start FROM files)
SELECT previous_end, next_start FROM pairs WHERE previous_end <> next_start""",
    # decoding
    "decode_matches": f"""
SELECT match_id, {_case("game_mode", _MODES)} AS game_mode_name, {_case("lobby_type", _LOBBIES)} AS lobby_type_name,
  good_mode AS serious_game, good_lobby AS serious_lobby, {_flags("dire")}, {_flags("radiant")}
FROM serious""",
    "decode_players": f"""
SELECT match_id, player_slot, pos AS team_slot, player_slot < 128 AS radiant,
  account_id IS NOT NULL AND account_id <> -1 AS known_account,
  CASE WHEN leaver_status IS NULL THEN 'BOT' ELSE {_case("leaver_status", _LEAVERS)} END AS leaver_status_name,
  hero_id, CAST(position AS INTEGER) AS position, CAST(item_ids[position + 1] AS INTEGER) AS item_id,
  h.name AS hero_name, 'item_' || item_ids[position + 1] AS item_name,
  {_case("position", _SLOTS)} AS item_slot
FROM (SELECT *, unnest(range(0, 6)) AS position FROM mp) LEFT JOIN hero_dim h USING (hero_id)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL per registered query. A body that starts with a comma adds its own views."""
    found = {}
    for name, body in _BODIES.items():
        found[name] = f"{_VIEWS.strip()}\n{body.strip()}"
    return found
