"""Streaks advanced by batches against the whole history, late games and ties included."""

import random

import pytest
from pyspark.sql import functions as F
from test_timeline import CUTS

from matchlake.operators import derive, progress, timeline
from matchlake.plans import queries

SCHEMA = "account_id long, ts long, match_id long, win boolean, real_match double"


def games(seed, n=260):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.randrange(120), m, rng.random() < 0.6, rng.choice([None, 1.0, 2.0, 3.0, 3.0])) for m in range(n)]
    return rows + [(None, 5, n, True, 3.0)]


@pytest.mark.parametrize("sizes", CUTS[:2])
@pytest.mark.parametrize("late", [0, 0.03])
def test_batches_equal_the_whole_history(spark, tmp_path, sizes, late):
    rng, rows = random.Random(9), games(3)
    batch = lambda r: 3 if rng.random() < late else min(r[1] // 30, 3)
    dealt = [(r, batch(r)) for r in rows]
    folder = str(tmp_path / "progress")
    for number in range(4):
        own = spark.createDataFrame([r for r, b in dealt if b == number], SCHEMA)
        upto = spark.createDataFrame([r for r, b in dealt if b <= number], SCHEMA)
        progress.advance_tables(spark, folder, number, own, upto, **sizes)
    history = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    found = progress.current_rows(spark, folder, 3)
    expected = timeline.signed_streaks(history, "ts")
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    state = spark.read.parquet(f"{folder}/state-3")
    assert sorted(map(tuple, progress.games_played(state).collect())) == sorted(map(tuple, derive.games_played(history).collect()))
    replayed = sum(spark.read.parquet(f"{folder}/replayed-{k}").count() for k in range(4))
    assert (replayed > 0) == (late > 0)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 7, m, m % 3 == 0, 3.0) for m in range(40)] + [(1, 8, m, True, 3.0) for m in range(40, 44)]
    shuffled = random.Random(2).sample(rows, len(rows))
    one, two = (sorted(map(tuple, timeline.signed_streaks(spark.createDataFrame(r, SCHEMA), "ts").collect())) for r in (rows, shuffled))
    assert one == two
    score, expected = 0, []
    for _, ts, m, win, _ in rows:
        expected.append((1, ts, m, win, m + 1, m + 1, score))
        score = (max(score, 0) + 1) if win else (min(score, 0) - 1)
    assert one == expected


def test_empty_batch_changes_nothing(spark):
    first = progress.advance(progress.no_state(spark), spark.createDataFrame(games(4), SCHEMA), spark.createDataFrame(games(4), SCHEMA))
    none = spark.createDataFrame([], SCHEMA)
    after = progress.advance(first.state, none, none)
    assert after.rows.collect() == [] and sorted(map(tuple, after.state.collect())) == sorted(map(tuple, first.state.collect()))


def test_a_batch_reads_its_inputs_a_fixed_number_of_times(spark, tmp_path):
    rows, folder = games(6), str(tmp_path / "progress")
    first = [r for r in rows if r[1] < 60 and r[2] % 9]
    table = spark.createDataFrame(first, SCHEMA)
    progress.advance_tables(spark, folder, 0, table, table)
    read = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def watched(some, count):
        def seen(_):
            count.add(1)
            return True

        return spark.createDataFrame(some, SCHEMA).where(F.udf(seen, "boolean")("match_id"))

    late = [r for r in rows if r not in first]
    progress.advance_tables(spark, folder, 1, watched(late, read[0]), watched(rows, read[1]))
    assert spark.read.parquet(f"{folder}/replayed-1").count() > 0
    assert read[0].value <= 2 * len(late) and read[1].value <= len(rows)


def test_batches_of_the_query_are_read_from_written_games(spark, monkeypatch):
    given = []
    monkeypatch.setattr(progress, "advance_tables", lambda *args: given.extend(args[3:5]))
    queries._advanced(spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in given]
    assert len(plans) == 6 and not any("Aggregate" in p or "Generate" in p for p in plans)
