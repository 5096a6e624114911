"""Order-sensitive operators against brute force, with and without cut entities."""

import random
from collections import Counter, defaultdict
from statistics import mean, pstdev

import pytest

from matchlake.operators import quality, segments, timeline

SCHEMA = "account_id long, ts long, win boolean, real_match double"


def make_games(seed):
    """One account holds most games, some have few, one has bursts of games."""
    rng = random.Random(seed)
    rows = []
    for account, n in [(1, 120), (2, 7), (3, 1), (4, 30), (5, 3), (6, 0), (7, 12)]:
        times = rng.sample(range(10_000), n)
        if account == 4:
            times = rng.sample(range(20), 15) + rng.sample(range(9_000, 9_040), 15)
        for ts in times:
            status = rng.choice([None, 1.0, 2.0, 3.0, 3.0])
            rows.append((account, ts, rng.random() < 0.6, status))
    rng.shuffle(rows)
    return rows


def per_account(rows):
    games = defaultdict(list)
    for row in sorted(rows):
        games[row[0]].append(row)
    return games


def brute_streaks(rows):
    """(account, ts, streak, game_no, real_no, win) of real games."""
    out = []
    for account, games in per_account(rows).items():
        score = real_no = 0
        for game_no, (_, ts, win, status) in enumerate(games, 1):
            if status is None or status < 2:
                continue
            real_no += 1
            out.append((account, ts, score, game_no, real_no, win))
            if win:
                score = score + 1 if score > 0 else 1
            else:
                score = score - 1 if score < 0 else -1
    return out


CUTS = [{}, {"min_rows": 1, "max_share": 40}, {"min_rows": 4, "max_share": 10_000}, {"min_rows": 1, "max_share": 10_000}]


@pytest.mark.parametrize("sizes", CUTS)
@pytest.mark.parametrize("seed", [1, 2])
def test_streaks(spark, seed, sizes):
    rows = make_games(seed)
    games = spark.createDataFrame(rows, SCHEMA)
    expected = brute_streaks(rows)
    found = timeline.streak_values(games, 3, **sizes).collect()
    assert sorted(map(tuple, found)) == sorted(r[:3] for r in expected if r[4] > 3)

    by_streak = defaultdict(list)
    for _, _, streak, game_no, _, win in expected:
        if game_no > 2:
            by_streak[streak].append(win)
    rates = {r.streak: (r.win_rate, r.games) for r in timeline.streak_win_rate(games, 2, **sizes).collect()}
    assert rates == {s: (pytest.approx(mean(w)), len(w)) for s, w in by_streak.items()}


@pytest.mark.parametrize("sizes", CUTS)
@pytest.mark.parametrize("window", [1, 5, 40])
def test_windows_have_no_gap_at_cuts(spark, window, sizes):
    rows = make_games(3)
    expected = []
    for account, games in per_account(rows).items():
        wins = [w for _, _, w, status in games if status is not None and status >= 2]
        if wins:
            for i in range(max(len(wins) - window, 0) + 1):
                part = wins[i : i + window]
                expected.append((account, i + 1, round(sum(part) / len(part), 9)))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = timeline.win_rate_windows(frame, window, **sizes).collect()
    assert sorted((r[0], r[1], round(r[2], 9)) for r in found) == sorted(expected)

    by_number = defaultdict(list)
    for _, number, rate in expected:
        by_number[number].append(rate)
    summary = {r.window_no: r for r in timeline.win_rate_vs_games(frame, window, **sizes).collect()}
    assert set(summary) == set(by_number)
    for number, rates in by_number.items():
        assert summary[number].size == len(rates)
        assert summary[number]["mean"] == pytest.approx(mean(rates), abs=1e-8)
        assert summary[number]["stdev"] == pytest.approx(pstdev(rates), abs=1e-8)


def test_split_keeps_order_and_bounds(spark):
    rows = [(1, t * t) for t in range(500)] + [(2, t) for t in range(20)]
    # Bursts inside bursts, and many games at one moment.
    rows += [(3, 10**12)] + [(3, 10**6 + t) for t in range(300)] + [(3, 10**9 + 1000 * t) for t in range(300)]
    rows += [(4, t) for t in range(5)] + [(4, 10**6)] * 70
    frame = spark.createDataFrame(rows, "k long, ts long")
    cut = segments.split(frame, ("k",), "ts", min_rows=50, max_share=1000)
    found = cut.rows.collect()
    assert sorted((r.k, r.ts) for r in found) == sorted(rows)
    for key in (1, 2, 3, 4):
        ordered = [r.segment for r in sorted((r for r in found if r.k == key), key=lambda r: r.ts)]
        assert ordered == sorted(ordered)
    sizes = Counter((r.k, r.segment) for r in found)
    assert max(n for (k, _), n in sizes.items() if k != 4) <= 50
    assert len([k for k, _ in sizes if k == 2]) == 1
    assert cut.large_rows.count() == 500 + 601 + 75


def test_no_cut_leaves_no_join(spark):
    frame = spark.createDataFrame(make_games(5), SCHEMA)
    plan = timeline.streak_values(frame, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("sizes", CUTS)
def test_sequence_gaps(spark, sizes):
    ranges = [(0, 30), (30, 60), (60, 95), (90, 120), (150, 180), (150, 170), (180, 210), (210, 240)]
    files = spark.createDataFrame([(f"matches_{a}-{b}.gz",) for a, b in ranges], "file_name string")
    found = quality.sequence_gaps(files, **sizes).collect()
    ordered = sorted(ranges)
    expected = [(p[1], c[0]) for p, c in zip(ordered, ordered[1:], strict=False) if p[1] != c[0]]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_empty_timelines(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert timeline.streak_values(empty, 1).count() == 0
    assert timeline.win_rate_vs_games(empty, 3).count() == 0
    assert quality.sequence_gaps(spark.createDataFrame([], "file_name string")).count() == 0


def test_group_win_rate_skips_missing_values(spark):
    rows = [(1, 1, True, 3.0), (1, 2, False, 3.0), (2, 1, True, None), (2, 2, True, 1.0)]
    found = timeline.group_win_rate(spark.createDataFrame(rows, SCHEMA), "real_match").collect()
    assert {r.real_match: (r["size"], r["mean"], r["stdev"]) for r in found} == {
        3.0: (2, 0.5, 0.5),
        1.0: (1, 1.0, 0.0),
    }
