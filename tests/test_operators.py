"""Edge cases and brute-force checks on small hand-made frames."""

import random
from collections import Counter, defaultdict
from pathlib import Path
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake import session
from matchlake.operators import (
    classify,
    clusters,
    correlation,
    derive,
    herostats,
    histogram,
    picks,
    quality,
    skill,
)
from matchlake.sources import cells

TIMELINE = "account_id long, ts long, hero_id int, win boolean, real_match double"
TRIPLES = "index long, vec int, val double, size long"
RATES = "hero_id int, slot_ms long, games_played double, win_rate double"
MATCHES = (
    "match_id long, start_ms long, game_mode int, lobby_type int, human_players int, radiant_win boolean,"
    " players array<struct<account_id:int, hero_id:int, player_slot:int, leaver_status:int>>"
)


def seat(account, leaver=0, hero=1, slot=0):
    return (account, hero, slot, leaver)


def match(match_id, players, start=1000, mode=1, lobby=0, humans=10, win=True):
    return (match_id, start, mode, lobby, humans, win, players)


# --- classification ---------------------------------------------------------------------


def test_real_match_statuses(spark):
    frame = spark.createDataFrame(
        [
            match(1, [seat(1), seat(2)]),
            match(2, [seat(1), seat(2, 1)]),
            match(3, [seat(1, 1), seat(2, 3)]),
            match(4, [seat(1), seat(2, None)]),
            match(5, []),
            match(6, [seat(1)], mode=7),
            match(7, [seat(1)], lobby=1),
            match(8, [seat(1)], humans=9),
            match(9, [seat(1)], mode=12, lobby=6),
            match(10, [seat(1)], mode=14, lobby=5),
        ],
        MATCHES,
    )
    found = {r.match_id: r.real_match for r in classify.real_matches(frame).collect()}
    assert found == {1: 3.0, 2: 2.0, 3: 1.0, 4: 1.0, 5: 3.0, 9: 3.0, 10: 3.0}
    assert {r.ts for r in classify.real_matches(frame, ts=7).collect()} == {7}
    counters = classify.real_match_counters(frame).first().asDict()
    assert counters == {
        "good_matches": 7,
        "bad_game_mode": 1,
        "bad_lobby": 1,
        "leavers": 2,
        "safe_leavers": 1,
        "real_match_with_leavers": 2,
        "real_match_with_safe_leavers": 1,
        "bad_matches": 3,
        "under_ten_players": 1,
    }


def test_transfer_collapses_and_filters(spark):
    frame = spark.createDataFrame(
        [
            match(1, [seat(5), seat(5), seat(-1), seat(None)]),
            match(2, [seat(5)]),
            match(3, [seat(6)], start=2000, mode=9),
        ],
        MATCHES,
    )
    derived = derive.with_derived(
        frame,
        real_match=classify.real_match_status(),
        third=F.when(F.col("match_id") < 3, F.col("match_id") / 4),
    )
    found = derive.transfer(derived).collect()
    assert sorted(map(tuple, found)) == [(5, "real_match", 1000, 3.0), (5, "third", 1000, 0.5)]
    # The pattern must match the whole qualifier.
    assert derive.transfer(derived, "real").count() == 0
    assert derive.transfer(derived, "real.*|x").count() == 1


def test_games_played_counts_only_players_with_cells(spark):
    rows = [(1, 1, 1, True, 1.0), (1, 2, 1, True, 3.0), (2, 1, 1, True, None), (3, 1, 1, True, 1.0)]
    found = derive.games_played(spark.createDataFrame(rows, TIMELINE), ts=9).collect()
    assert sorted(map(tuple, found)) == [(1, 9, 1.0), (3, 9, 0.0)]


# --- cells ------------------------------------------------------------------------------


def test_cells_upsert_latest_and_files(spark, tmp_path):
    schema = "entity long, qualifier string, ts long, value double"
    stored = spark.createDataFrame([(1, "a", 1, 1.0), (1, "a", 2, 2.0), (2, "b", 1, 3.0)], schema)
    puts = spark.createDataFrame([(1, "a", 2, -5.0), (1, "b", 0, 4.0)], schema)
    after = cells.upsert(stored, puts)
    assert sorted(map(tuple, after.collect())) == [
        (1, "a", 1, 1.0), (1, "a", 2, -5.0), (1, "b", 0, 4.0), (2, "b", 1, 3.0),
    ]
    assert sorted(map(tuple, cells.latest(after).collect())) == [
        (1, "a", 2, -5.0), (1, "b", 0, 4.0), (2, "b", 1, 3.0),
    ]
    path = str(tmp_path / "cells")
    cells.write(after, path)
    only = cells.matching(cells.read(spark, path), "b")
    assert sorted(map(tuple, only.collect())) == [(1, "b", 0, 4.0), (2, "b", 1, 3.0)]
    assert "PartitionFilters: [isnotnull(qualifier" in only._jdf.queryExecution().toString()


def test_cells_from_columns_skip_nulls(spark):
    frame = spark.createDataFrame([(1, 10, 2, None), (2, 20, 3, 0.5)], "id long, t long, a int, b double")
    found = cells.from_columns(frame, "id", "t", a="a", bee="b").collect()
    assert sorted(map(tuple, found)) == [(1, "a", 10, 2.0), (2, "a", 20, 3.0), (2, "bee", 20, 0.5)]


# --- hero statistics --------------------------------------------------------------------


def brute_sliding(slots, interval_ms, window_size, step, min_games):
    """slots: {start_ms: (games, rate)} of one hero."""
    first = min(slots)
    start = first - first % (step * interval_ms)
    grid = [slots.get(t, (0, 0.0)) for t in range(start, max(slots) + 1, interval_ms)]
    out = {}
    for i in range(0, len(grid), step):
        for r in range(len(grid)):
            part = grid[max(0, i - r) : i + r + 1]
            games = sum(g for g, _ in part)
            if len(part) >= window_size and games >= min_games:
                out[start + i * interval_ms] = (games, sum(g * w for g, w in part) / games)
                break
    return out


@pytest.mark.parametrize(("window", "step", "need"), [(1, 1, 1), (3, 2, 10), (5, 4, 40), (9, 8, 1000), (7, 3, 0.5)])
def test_sliding_win_rates(spark, window, step, need):
    rng = random.Random(window)
    data = {h: {} for h in (1, 2, 3)}
    for h, span in ((1, 60), (2, 12)):
        for slot in rng.sample(range(5, 5 + span), span // 2):
            data[h][slot * 2000] = (float(rng.randint(1, 9)), rng.random())
    data[3][14_000] = (4.0, 0.25)
    rows = [(h, t, g, w) for h, slots in data.items() for t, (g, w) in slots.items()]
    found = herostats.sliding_hero_win_rates(spark.createDataFrame(rows, RATES), 2, window, step, need)
    expected = {}
    for h, slots in data.items():
        for t, (g, w) in brute_sliding(slots, 2000, window, step, need).items():
            expected[h, t] = (pytest.approx(g), pytest.approx(w))
    assert {(r.hero_id, r.slot_ms): (r.games_played, r.win_rate) for r in found.collect()} == expected


def test_sliding_window_must_be_odd(spark):
    with pytest.raises(ValueError, match="odd"):
        herostats.sliding_hero_win_rates(spark.createDataFrame([], RATES), 1, 4, 1, 1)


def test_hero_win_rates_min_status(spark):
    players = [seat(1, hero=4), seat(-1, hero=4, slot=128), seat(None, hero=5, slot=129)]
    abandoned = [(1, 4, 0, 2)]
    frame = spark.createDataFrame(
        [match(1, players, start=3500), match(2, abandoned, start=3999), match(3, players, mode=8)], MATCHES
    )
    rates = {(r.hero_id, r.slot_ms): (r.games_played, r.win_rate) for r in herostats.hero_win_rates(frame, 1).collect()}
    assert rates == {(4, 3000): (3.0, pytest.approx(2 / 3)), (5, 3000): (1.0, 0.0)}
    real = herostats.hero_win_rates(frame, 1, min_status=2.0).collect()
    assert {(r.hero_id, r.games_played) for r in real} == {(4, 2.0), (5, 1.0)}


# --- skill ------------------------------------------------------------------------------


@pytest.mark.parametrize(("drop", "need"), [(0, 1), (3, 1), (2, 4)])
def test_hero_skill(spark, drop, need):
    rng = random.Random(drop)
    rows = []
    for account, n in ((1, 200), (2, 5), (3, 2), (4, 40)):
        for ts in rng.sample(range(5000), n):
            rows.append((account, ts, rng.randint(1, 3), rng.random() < 0.5, rng.choice([None, 1.0, 2.0, 3.0])))
    rates = {(h, t): rng.random() for h in (1, 2) for t in range(0, 5000, 1000) if t != 2000}
    frame = spark.createDataFrame(rows, TIMELINE)
    kept = defaultdict(list)
    for account in range(1, 5):
        games = sorted(r for r in rows if r[0] == account and (r[4] or 0) >= 2)[drop:]
        for g in games:
            kept[account, g[2]].append(g)
    kept = {k: g for k, g in kept.items() if len(g) >= need}

    raw = skill.hero_skill_raw(frame, drop, need).collect()
    assert {(r.account_id, r.hero_id): (r.score, r["size"]) for r in raw} == {
        k: (pytest.approx(mean(g[3] for g in games)), len(games)) for k, games in kept.items()
    }

    expected = {}
    for (account, hero), games in kept.items():
        scores = [g[3] - rates[hero, g[1] // 1000 * 1000] for g in games if (hero, g[1] // 1000 * 1000) in rates]
        if scores:
            expected[account, hero] = (pytest.approx(mean(scores)), len(scores))
    table = spark.createDataFrame([(h, t, 1.0, w) for (h, t), w in rates.items()], RATES)
    adjusted = skill.hero_skill_adjusted(frame, table, 1, drop, need).collect()
    assert {(r.account_id, r.hero_id): (r.score, r["size"]) for r in adjusted} == expected


# --- correlations -----------------------------------------------------------------------


def make_triples(spark):
    rng = random.Random(4)
    rows = []
    for index in range(40):
        for vec in rng.sample([1, 2, 3, 5, 8], rng.randint(1, 5)):
            rows.append((index, vec, float(rng.randint(0, 6)), rng.randint(1, 9)))
    rows += [(index, 9, 2.0, 5) for index in range(10)]
    return spark.createDataFrame(rows, TRIPLES)


def test_shared_correlations(spark):
    triples = make_triples(spark)
    found = {(r.vec, r.vec2): (r.cor, r["size"]) for r in correlation.shared_correlations(triples).collect()}
    a = triples.select("index", F.col("vec").alias("a"), F.col("val").alias("x"))
    b = triples.select("index", F.col("vec").alias("b"), F.col("val").alias("y"))
    pairs = a.join(b, "index").where("a < b and b <> 9").groupBy("a", "b")
    for row in pairs.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).collect():
        assert found[row.a, row.b] == (pytest.approx(row.r), row.n)
    # A constant vector has no correlation.
    assert all(cor is None for (_, vec2), (cor, _) in found.items() if vec2 == 9)
    filtered = correlation.shared_correlations(triples, size_filter=9)
    assert filtered.count() == 0


def dense_pairs(values):
    """Lower, upper and both values of all pairs of one index, by position."""
    return {(a, b, values[a], values[b]) for a in values for b in values if a < b}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 9, 23])
def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(correlation, "BLOCK", 3)
    rng = random.Random(size)
    values = {v: float(v * v) for v in rng.sample(range(-50, 50), size)}
    rows = [(5, v, x, 1) for v, x in values.items()] + [(6, 1, 2.0, 1), (6, 2, None, 1), (None, 1, 1.0, 1), (6, None, 1.0, 1)]
    found = correlation._pairs(spark.createDataFrame(rows, TRIPLES)).collect()
    wanted = dense_pairs(values) | {(1, 2, 2.0, None)}
    assert len(found) == len(wanted)
    assert {(r.lower, r.upper, r.x, r.y) for r in found} == wanted


def test_correlations_in_blocks_equal_those_in_one(spark, monkeypatch):
    triples = make_triples(spark)
    ways = [
        correlation.shared_correlations,
        lambda t: correlation.matrix_correlations(t, 60),
        lambda t: correlation.present_correlations(t, 60),
        lambda t: correlation.range_correlations(t, 60, 1, 10),
    ]
    whole = [sorted(map(tuple, way(triples).collect())) for way in ways]
    monkeypatch.setattr(correlation, "BLOCK", 2)
    for way, rows in zip(ways, whole, strict=True):
        found = sorted(map(tuple, way(triples).collect()))
        assert [r[:2] for r in found] == [r[:2] for r in rows]
        assert [r[2] for r in found] == pytest.approx([r[2] for r in rows], nan_ok=True)


def test_index_with_many_vectors_is_spread(spark):
    """10^5 vectors at one index: blocks are bounded, each two meet once, keys go to many tasks."""
    vectors = 100_000
    lists = spark.range(vectors).select(F.lit(1).alias("index"), F.struct("id", F.lit(1.0)).alias("v"))
    lists = lists.groupBy("index").agg(F.collect_list("v").alias("values"))
    met = correlation._block_pairs(lists, correlation.BLOCK).select(
        F.size("lows").alias("a"), F.size("highs").alias("b"),
        (F.col("lows")[0]["id"] == F.col("highs")[0]["id"]).alias("same"), F.spark_partition_id().alias("task"),
    )
    found = met.agg(
        F.count("*").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"), F.countDistinct("task").alias("tasks"),
        F.sum(F.when(F.col("same"), F.expr("a * (a - 1) div 2")).otherwise(F.expr("a * b"))).alias("pairs"),
    ).first()
    blocks = -(-vectors // correlation.BLOCK)
    assert (found.n, found.a, found.b) == (blocks * (blocks + 1) // 2, correlation.BLOCK, correlation.BLOCK)
    assert found.pairs == vectors * (vectors - 1) // 2 and found.tasks == 8


def test_full_length_correlations_agree(spark):
    import numpy as np

    triples = make_triples(spark)
    dense = np.zeros((60, 11))
    for r in triples.collect():
        dense[r["index"], r.vec] = r.val
    with np.errstate(invalid="ignore", divide="ignore"):
        table = np.corrcoef(dense.T)
    ranged = {(r.vec1, r.vec2): r.cor for r in correlation.range_correlations(triples, 60, 1, 10).collect()}
    present = {(r.vec1, r.vec2): r.cor for r in correlation.present_correlations(triples, 60).collect()}
    vectors = {1, 2, 3, 5, 8, 9}
    assert set(present) == {(a, b) for a in vectors for b in vectors if a > b}
    assert set(ranged) == {
        (a, b) for a in range(1, 11) for b in range(1, a) if a in vectors or b in vectors
    }
    for pair, cor in ranged.items():
        if pair in present:
            assert cor == pytest.approx(table[pair]) and cor == pytest.approx(present[pair])
        else:
            assert cor is None

    matrix = {(r.vec1, r.vec2): r.cor for r in correlation.matrix_correlations(triples, 60).collect()}
    normal = np.zeros_like(dense)
    for v in vectors:
        values = {r["index"]: r.val for r in triples.collect() if r.vec == v}
        average = sum(values.values()) / 60
        deviation = (sum((x - average) ** 2 for x in values.values()) / 60) ** 0.5
        for i, x in values.items():
            normal[i, v] = (x - average) / deviation
    for (a, b), cor in matrix.items():
        assert cor == pytest.approx(normal[:, a] @ normal[:, b] / 60)


def test_named_correlations_order_and_unknown(spark):
    schema = "vec int, vec2 int, cor double, size long"
    rows = [(1, 2, -0.9, 5), (1, 3, 0.1, 9), (2, 3, float("nan"), 9), (2, 4, None, 9), (3, 4, 0.5, 2)]
    heroes = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "hero_id int, name string")
    named = correlation.named_correlations(spark.createDataFrame(rows, schema), heroes)
    assert [tuple(r) for r in named.collect()] == [
        ("one", "three", 0.1, 9), ("three", "UNKNOWN", 0.5, 2), ("one", "two", -0.9, 5),
    ]
    large = correlation.named_correlations(spark.createDataFrame(rows, schema), heroes, min_size=5)
    assert [r.cor for r in large.collect()] == [0.1]


# --- picks and clusters -----------------------------------------------------------------


def test_row_numbers_are_dense_over_blocks(spark):
    accounts = [3, 65_535, 65_536, 70_000, 200_000, 2_000_000_000, 7]
    rows = [(a, t, 1, True, 1.0) for a in accounts for t in range(2)]
    rows += [(9, 1, 1, True, 3.0), (10, 1, 1, True, None), (10, 2, 1, True, None)]
    found = picks.player_row_numbers(spark.createDataFrame(rows, TIMELINE), 2).collect()
    assert {r.account_id: r.row_number for r in found} == {a: float(i) for i, a in enumerate(sorted(accounts))}


def test_row_numbers_of_wide_ids(spark):
    """Ids of 64 bits, in blocks that differ in any of their bits; none is first."""
    rng = random.Random(8)
    accounts = {rng.randrange(-(1 << bits), 1 << bits) for bits in range(4, 64) for _ in range(6)}
    accounts |= {-(1 << 63), (1 << 63) - 1, 0, -1}
    rows = [(a, 1, 1, True, 1.0) for a in [None, *accounts]]
    numbers = picks.player_row_numbers(spark.createDataFrame(rows, TIMELINE), 1)
    found = {r.account_id: r.row_number for r in numbers.collect()}
    assert found == {a: float(i) for i, a in enumerate([None, *sorted(accounts)])}


def test_shares_and_vectors(spark):
    rows = [(1, t, 1 + t % 2, True, 1.0) for t in range(3)] + [(2, 1, 5, True, 2.0), (3, 1, 1, True, None)]
    games = spark.createDataFrame(rows, TIMELINE)
    shares = picks.hero_pick_share(games, picks.player_row_numbers(games, 1))
    found = {(r.player_row, r.hero_id): r.share for r in shares.collect()}
    assert found == {(0, 1): pytest.approx(2 / 3), (0, 2): pytest.approx(1 / 3), (1, 5): 1.0}
    vectors = picks.pick_vectors(shares, block_rows=1).collect()
    assert {(r.hero_id, r.block, tuple(r.indices)) for r in vectors} == {(1, 0, (0,)), (2, 0, (0,)), (5, 1, (1,))}


def brute_kmeans(vectors, k, iterations):
    heroes = sorted(vectors)
    rows = sorted({r for v in vectors.values() for r in v})
    centres = [vectors[h] for h in heroes[:k]]

    def nearest(v):
        distances = [round(sum(abs(v.get(r, 0) - c.get(r, 0)) for r in rows), 9) for c in centres]
        return distances.index(min(distances))

    for _ in range(iterations):
        members = defaultdict(list)
        for h in heroes:
            members[nearest(vectors[h])].append(h)
        for c, group in members.items():
            centres[c] = {r: sum(vectors[h].get(r, 0) for h in group) / len(group) for r in rows}
    return {h: nearest(vectors[h]) for h in heroes}


@pytest.mark.parametrize("seed", [1, 2])
def test_hero_clusters(spark, seed):
    rng = random.Random(seed)
    vectors = {h: {r: rng.randint(1, 8) / 8 for r in rng.sample(range(12), 5)} for h in range(1, 15)}
    vectors[15] = dict(vectors[1])
    rows = [(h, r, x) for h, v in vectors.items() for r, x in v.items()]
    shares = spark.createDataFrame(rows, "hero_id int, player_row long, share double")
    found = {r.hero_id: r.cluster for r in clusters.hero_clusters(shares, 4, 2).collect()}
    assert found == brute_kmeans(vectors, 4, 2)


def test_equal_distances_go_to_the_lowest_cluster(spark):
    rows = [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    shares = spark.createDataFrame(rows, "hero_id int, player_row long, share double")
    found = {r.hero_id: r.cluster for r in clusters.hero_clusters(shares, 2, 0).collect()}
    assert found == {1: 0, 2: 1, 3: 0}
    heroes = spark.createDataFrame([(1, "b"), (3, "a")], "hero_id int, name string")
    named = clusters.name_clusters(clusters.hero_clusters(shares, 2, 0), heroes).collect()
    assert {r.cluster: r.heroes for r in named} == {0: "a, b", 1: "UNKNOWN"}


def test_sums_in_any_order_are_equal_distances(spark):
    """A tenth thrice and three tenths differ as doubles, but not as distances."""
    rows = [(1, r, 0.1) for r in range(3)] + [(2, 3, 0.3), (3, 4, 0.7)]
    shares = spark.createDataFrame(rows, "hero_id int, player_row long, share double")
    for order in ("player_row", "share"):
        found = clusters.hero_clusters(shares.orderBy(order), 2, 0).collect()
        assert {r.hero_id: r.cluster for r in found} == {1: 0, 2: 1, 3: 0}


def test_cluster_iterations_do_not_move_entries(spark, monkeypatch):
    """Once the entries are written, nothing shuffles by player row, and no table is left."""
    plans, folders = [], []
    write, checkpoint = session.BucketedTables.write, session.checkpoint

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    def written(tables, df):
        folders.append(tables.folder)
        if tables.names:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(tables, df)

    monkeypatch.setattr(clusters, "checkpoint", seen)
    monkeypatch.setattr(session.BucketedTables, "write", written)
    rows = [(h, r, 0.5) for h in range(8) for r in range(h, 40)]
    shares = spark.createDataFrame(rows, "hero_id int, player_row long, share double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert clusters.hero_clusters(shares, 3, 2).count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) == 6 and len(set(folders)) == 1
    assert not any("hashpartitioning(player_row" in plan for plan in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    assert not Path(folders[0].removeprefix("file:")).exists()


# --- histograms -------------------------------------------------------------------------

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def test_weekly_histogram_edges(spark):
    schema = "field string, value string, start long, end long, count long"
    first = 20 * DAY_MS
    rows = [
        ("game_mode", "0", 0, DAY_MS, 99),
        ("game_mode", "0", first, first + DAY_MS, 1),
        ("game_mode", "6", first + WEEK_MS - DAY_MS, 0, 2),
        ("game_mode", "99", first + WEEK_MS, 0, 4),
        ("game_mode", "1", first + 2 * WEEK_MS, 0, 8),
        ("lobby_type", "-1", first + DAY_MS, 0, 16),
        ("lobby_type", "2", first + 3 * DAY_MS, 0, 32),
        ("only", "x", first, 0, 64),
    ]
    found = histogram.weekly_histogram(spark.createDataFrame(rows, schema))
    table = {(r.field, r.value, r.bin_ms): r["count"] for r in found.collect()}
    assert table == {
        ("game_mode", "GAME_MODE_ZERO", first): 1,
        ("game_mode", "GAME_MODE_ZERO", first + WEEK_MS): 0,
        ("game_mode", "GAME_MODE_SIX", first): 2,
        ("game_mode", "GAME_MODE_SIX", first + WEEK_MS): 0,
        ("game_mode", "99", first): 0,
        ("game_mode", "99", first + WEEK_MS): 4,
        # The slot on the last edge is lost.
        ("game_mode", "ALL_PICK", first): 0,
        ("game_mode", "ALL_PICK", first + WEEK_MS): 0,
        ("lobby_type", "INVALID", first + DAY_MS): 16,
        ("lobby_type", "TOURNAMENT", first + DAY_MS): 32,
    }
    wide = histogram.weekly_histogram_wide(found, "game_mode")
    assert wide.columns == ["value", "01-21-1970", "01-28-1970"]
    assert {tuple(r) for r in wide.collect()} == {
        ("GAME_MODE_ZERO", 1, 0), ("GAME_MODE_SIX", 2, 0), ("99", 0, 4), ("ALL_PICK", 0, 0),
    }


def test_histograms_and_missing_values(spark):
    schema = "match_id long, start_ms long, a int, b int"
    rows = [(1, 999, 1, 2), (2, 1000, 1, None), (3, 1500, None, 2)]
    frame = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in histogram.histogram(frame, "a", 1).collect()} == {("1", "0-1000", 1), ("1", "1000-2000", 1)}
    assert {tuple(r) for r in histogram.multi_histogram(frame, ["a", "b"], 1).collect()} == {
        ("a", "1", 0, 1000, 1),
        ("b", "2", 0, 1000, 1),
    }
    keys = [histogram.value_key("data", "a", 1), histogram.value_key("data", "b")]
    assert {tuple(r) for r in histogram.key_histogram(frame, *keys).collect()} == {
        ("data:a=1 [0-1000)", 1),
        ("data:a=1 [1000-2000)", 1),
        ("data:a=NULL [1000-2000)", 1),
        ("data:b=2", 2),
        ("data:b=NULL", 1),
    }


def test_winner_percent_has_total(spark):
    counts = spark.createDataFrame([(0, 1), (6, 3)], "raxes_left int, games_won long")
    found = {r.raxes_left: (r.games_won, r.percent) for r in histogram.winner_rax_percent(counts).collect()}
    assert found == {0: (1, 0.25), 6: (3, 0.75), None: (4, 1.0)}


# --- integrity checks -------------------------------------------------------------------


def test_compare_match_ids_keeps_repeats(spark):
    left = spark.createDataFrame([(i,) for i in (1, 1, 1, 2, 2, 4)], "match_id long")
    right = spark.createDataFrame([(i,) for i in (2, 3, 3, 4, 4)], "match_id long")
    found = Counter(map(tuple, quality.compare_match_ids(left, right).collect()))
    assert found == {(1, None): 3, (None, 3): 2}


def test_correlations_of_large_values(spark):
    """Small differences of large values count; vectors that do not vary have no correlation."""
    steps = [0.0, 0.3, -0.3, 0.6]
    rows = [(i, 1, 1e6 + steps[i % 4], 1) for i in range(200)] + [(i, 5, 1e6 - steps[i % 4] / 2, 1) for i in range(200)]
    rows += [(i, 900_000, 7.0, 1) for i in range(200)] + [(i, 9, 2.0, 1) for i in range(50)]
    triples = spark.createDataFrame(rows, "index int, vec int, val double, size int")
    found = {(r.vec1, r.vec2): r.cor for r in correlation.present_correlations(triples, 200).collect()}
    assert len(found) == 6
    assert found[5, 1] == pytest.approx(-1.0, abs=1e-6)
    assert found[900_000, 1] is None and found[900_000, 9] is None
    dense = {v: np.zeros(200) for v in (1, 5, 9)}
    for i, v, x, _ in rows:
        if v in dense:
            dense[v][i] = x
    assert found[9, 1] == pytest.approx(np.corrcoef(dense[9], dense[1])[0, 1], abs=1e-6)
    ranged = {(r.vec1, r.vec2): r.cor for r in correlation.range_correlations(triples, 200, 1, 9).collect()}
    assert ranged[5, 1] == found[5, 1] and ranged[2, 1] is None


def test_compare_match_ids_with_nulls(spark):
    left = spark.createDataFrame([(1,), (None,), (None,), (2,)], "match_id long")
    right = spark.createDataFrame([(1,), (None,), (3,)], "match_id long")
    found = Counter(map(tuple, quality.compare_match_ids(left, right).collect()))
    assert found == {(None, None): 3, (2, None): 1, (None, 3): 1}


def test_repeat_beyond_one_array(spark, monkeypatch):
    monkeypatch.setattr(quality, "_COPIES", 4)
    left = spark.createDataFrame([(1,)] * 11 + [(2,)] * 4, "match_id long")
    right = spark.createDataFrame([], "match_id long")
    found = Counter(map(tuple, quality.compare_match_ids(left, right).collect()))
    assert found == {(1, None): 11, (2, None): 4}


def test_compare_player_counts(spark):
    records = spark.createDataFrame(
        [(1, [(7,), (7,), (4294967295,), (None,), (4294967290,)]), (2, [(8,)])],
        "match_id long, players array<struct<account_id:long>>",
    )
    stored = spark.createDataFrame([(7, 1), (-6, 1), (9, 1), (8, None)], "account_id long, match_id long")
    found = {r.account_id: (r.record_matches, r.table_matches) for r in quality.compare_player_counts(records, stored).collect()}
    assert found == {7: (2, 1), 8: (1, None), 9: (None, 1)}


def test_counts_and_lookups(spark):
    records = spark.createDataFrame(
        [(1, [(7,), (4294967295,)]), (2, [(None,)]), (2, [])],
        "match_id long, players array<struct<account_id:long>>",
    )
    assert quality.count_unique_match_ids(records).first()[0] == 2
    assert quality.max_account_id(records).first()[0] == 7
    assert [r.match_id for r in quality.matches_for_player(records, 7).collect()] == [1]
    assert quality.count_lines(records).first()[0] == 3
    assert quality.count_cells(records.select(F.nullif("match_id", F.lit(1)).alias("m")), "m").first()[0] == 2


def test_example_values(spark):
    rows = [match(i, [seat(1, 0, slot=0), seat(2, None, slot=129), seat(3, 0, slot=130)]) for i in range(30, 0, -1)]
    frame = spark.createDataFrame(rows, MATCHES)
    found = quality.example_values(frame, "leaver_status", examples=3)
    assert sorted((r.value, r.match_id, r.player_slot, r.slot) for r in found.collect()) == [
        ("0", 1, 0, 0), ("0", 2, 0, 0), ("0", 3, 0, 0),
        ("null", 1, 129, 6), ("null", 2, 129, 6), ("null", 3, 129, 6),
    ]
    texts = {r.value: r.summary for r in quality.example_summaries(found).collect()}
    assert texts["null"].splitlines()[0] == "Match: 1 player: 129 (6)"
