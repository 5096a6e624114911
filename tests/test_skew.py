"""Queries on tables where one player and one hero hold a third of all rows."""

import functools
import shutil

import duckdb
import pytest
from comparison import connect, normal, rows_of_sql
from pyspark.sql import functions as F

from matchlake.operators import quality, segments, skill, timeline
from matchlake.plans.oracles import oracle_sql
from matchlake.plans.queries import QUERIES
from matchlake.sources import dimensions

SOURCE = "/root/testdata/sf0.01"
SQL = oracle_sql()
NAMES = [
    "compare_player_counts",
    "example_values",
    "games_played",
    "group_win_rate",
    "hero_clusters",
    "hero_pick_share",
    "hero_skill_adjusted",
    "hero_skill_raw",
    "hero_win_rates",
    "ingest_player_matches",
    "inmem_correlations",
    "latest_cells",
    "pick_correlations",
    "player_row_numbers",
    "sequence_gaps",
    "sliding_hero_win_rates",
    "streak_values",
    "streak_win_rate",
    "transfer_derived",
    "tuple_correlations",
    "upsert_cells",
    "validate_matches",
    "win_rate_vs_games",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("skewed")
    for name in ("lineitem", "part"):
        shutil.copy(f"{SOURCE}/{name}.parquet", path / f"{name}.parquet")
    duckdb.sql(
        f"""COPY (
          SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id, event_type, value,
                 CASE WHEN event_id % 3 = 1 THEN '{{"k": 44}}' ELSE props END AS props
          FROM '{SOURCE}/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)"""
    )
    return str(path)


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_query_equals_sql(spark, folder, connection, monkeypatch, name):
    # Small tables: cut what holds more than a fiftieth.
    cut = functools.partial(segments.split, min_rows=20, max_share=50)
    monkeypatch.setattr(timeline, "split", cut)
    monkeypatch.setattr(quality, "split", cut)
    frame = QUERIES[name](spark, folder)
    found = normal(frame.columns, [tuple(r) for r in frame.collect()])
    assert found == normal(*rows_of_sql(connection, SQL[name]))


def test_large_player_is_cut(spark, folder):
    from matchlake.sources import telemetry

    games = telemetry.player_timeline(spark, folder)
    cut = segments.split(games, ("account_id",), "ver_us", min_rows=20, max_share=50)
    sizes = {(r.account_id, r.segment): r["count"] for r in cut.rows.groupBy("account_id", "segment").count().collect()}
    assert sum(sizes.values()) == games.count()
    own = [n for (account, _), n in sizes.items() if account == 8]
    assert len(own) >= 15 and max(own) < sum(own) / 8


def test_nested_bursts_are_cut_until_they_fit(spark):
    """Bursts inside bursts: every segment fits in the end, and none breaks the order."""
    times = sorted({10**k * j for k in range(12) for j in range(40)} | set(range(3_000)))
    rows = spark.createDataFrame([(1, t) for t in times] + [(2, 5)], "account_id long, ts long")
    cut = segments.split(rows, ("account_id",), "ts", min_rows=20, max_share=100)
    found = cut.rows.where("account_id = 1").groupBy("segment").agg(
        F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")
    ).orderBy("segment").collect()
    assert max(r.n for r in found) <= max(20, (len(times) + 1) // 100)
    assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False))
    assert sum(r.n for r in found) == len(times)


def test_many_first_games(spark):
    """Leaving out more games than ranking keeps on the map side."""
    rows = [(1 + (k % 7 == 0), k, k % 3, k % 2 == 0, 2) for k in range(4_000)]
    timeline = spark.createDataFrame(rows, "account_id long, ts long, hero_id int, win boolean, real_match int")
    found = {(r.account_id, r.hero_id): (round(r.score * r.size), r.size) for r in skill.hero_skill_raw(timeline, 1_500, 1).collect()}
    expected = {}
    for account in (1, 2):
        for _, _, hero, win, _ in [r for r in rows if r[0] == account][1_500:]:
            wins, games = expected.get((account, hero), (0, 0))
            expected[account, hero] = (wins + win, games + 1)
    assert found == expected


def test_adjusted_skill_aggregates_once(spark):
    """Rates meet the games where they are read; one aggregate by player and hero."""
    games = spark.createDataFrame([(1, 5, 2, True, 2), (1, 9, 2, False, 2)], "account_id long, ts long, hero_id int, win boolean, real_match int")
    rates = spark.createDataFrame([(2, 0, 0.25)], "hero_id int, slot_ms long, win_rate double")
    frame = skill.hero_skill_adjusted(games, rates, 60, 0, 1)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "Window" not in plan
    assert [tuple(r) for r in frame.collect()] == [(1, 2, 0.25, 2)]


def test_rates_too_many_to_broadcast(spark):
    """Salted copies of the rates give what a broadcast gives, a hot player and hero included."""
    rows = [(k if k % 3 else 7, 300 * k, 1 + (k % 4 == 0) * (k % 5), k % 2 == 0, 2) for k in range(600)]
    games = spark.createDataFrame(rows, "account_id long, ts long, hero_id int, win boolean, real_match int")
    rates = spark.createDataFrame(
        [(hero, slot * 60_000, hero / 8) for hero in range(1, 5) for slot in range(3)], "hero_id int, slot_ms long, win_rate double"
    )
    small, large = (skill.hero_skill_adjusted(games, rates, 60, 0, 1, max_bytes=most) for most in (1 << 20, 0))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "salt" in large._jdf.queryExecution().analyzed().toString()
    found = [sorted((r.account_id, r.hero_id, round(r.score, 9), r.size) for r in f.collect()) for f in (small, large)]
    assert found[0] == found[1] and len(found[0]) > 350


def test_size_of_a_written_table(spark):
    table, size = dimensions.settle(spark.createDataFrame([(1, "ab"), (2, None)], "id long, name string"))
    assert size == 2 * (32 + 16) + 2 and table.count() == 2
    assert dimensions.settle(table.where("id > 5"))[1] == 0
