"""Import, files, streams, decoding, validation and command-line jobs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from matchlake import schemas
from matchlake.functions import fixed_values as fixed
from matchlake.functions import values
from matchlake.operators import classify, decode, ingest, quality, skill
from matchlake.plans import jobs
from matchlake.sources import cells, dimensions, files, telemetry
from matchlake.streaming.ingest_stream import import_new_files

FOLDER = "/root/testdata/sf0.001"

UNIT = {"unitname": "bear", **{f"item_{i}": i for i in range(6)}}


def raw_player(slot, account=None, **more):
    player = {
        f.name: 1
        for f in schemas.RAW_PLAYER.fields
        if f.name not in ("account_id", "leaver_status", "ability_upgrades", "additional_units")
    }
    player |= {"player_slot": slot, "xp_per_min": 2.5, "leaver_status": 0}
    if account is not None:
        player["account_id"] = account
    return player | more


def raw_match(match_id, players, **more):
    match = {
        f.name: 1 for f in schemas.RAW_MATCH.fields if f.name not in ("players", "radiant_win", "season")
    }
    match |= {"match_id": match_id, "players": players, "radiant_win": True, "start_time": 1_300_000_000}
    return match | more


def as_lines(spark, *matches):
    texts = [m if isinstance(m, str) else json.dumps(m) for m in matches]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_players_of_every_shape(spark):
    players = [
        raw_player(0, 7, ability_upgrades=[{"ability": 5, "time": 6, "level": 7}]),
        raw_player(1, 4294967295, additional_units=UNIT),
        raw_player(128, additional_units=[UNIT, {**UNIT, "unitname": "second"}], leaver_status=None),
        raw_player(129, 4294967290),
    ]
    row = ingest.ingest_matches(as_lines(spark, raw_match(3, players))).first()
    assert row.start_ms == 1_300_000_000_000 and row.season is None
    assert [p.account_id for p in row.players] == [7, -1, None, -6]
    assert row.players[0].ability_upgrades == [(7, 5, 6)]
    assert [p.ability_upgrades for p in row.players[1:]] == [[], [], []]
    assert [p.additional_units and p.additional_units.name for p in row.players] == [None, "bear", "bear", None]
    assert row.players[1].additional_units.item_ids == [0, 1, 2, 3, 4, 5]
    assert row.players[2].leaver_status is None and row.players[0].exp_per_minute == 2.5
    names = [f.name for f in ingest.ingest_matches(as_lines(spark, raw_match(3, []))).schema["players"].dataType.elementType]
    assert names == schemas.PLAYER.fieldNames()


def test_other_players_keep_their_order(spark):
    players = [raw_player(i, a) for i, a in enumerate([5, None, 5, 4294967295, 6])]
    found = ingest.ingest_player_matches(as_lines(spark, raw_match(1, players))).collect()
    others = {r.player.player_slot: [p.player_slot for p in r.other_players] for r in found}
    assert others == {0: [1, 2, 3, 4], 2: [0, 1, 3, 4], 4: [0, 1, 2, 3]}
    assert {r.ts for r in found} == {1_300_000_000_000}


def test_malformed_lines(spark):
    bad = ['{"match_id": 2, "pla', "", "   ", "null", "[]", '{"match_id":4}xyz', '{"match_id":5}{"match_id":6}', '{"match_id":7},{"match_id":8}']
    lines = as_lines(spark, raw_match(1, []), *bad, raw_match(3, [raw_player(0)]))
    assert sorted(r.match_id for r in ingest.parse_good_lines(lines).collect()) == [1, 3]
    assert tuple(ingest.count_malformed(lines).first()) == (2, len(bad))
    for line in bad:
        with pytest.raises(Exception, match="MALFORMED"):
            ingest.ingest_matches(as_lines(spark, line)).collect()


def test_quarantine_keeps_lines_with_reasons(spark, tmp_path):
    good = json.dumps(raw_match(1, [raw_player(0, 5)]))
    bad = {
        good[: len(good) // 2]: "not JSON", good + good: "not JSON", good + " x": "not JSON", '{"match_id":1,"match_id":2}': "not JSON",
        good + "," + good: "several records", f"[{good}]": "not a record", "7": "not a record", "null": "not a record", "": "blank", "  ": "blank",
    }
    (tmp_path / "raw").mkdir()
    for i in range(2):
        (tmp_path / "raw" / f"matches_{i}.json").write_text("\n".join([good, *bad]) + "\n")
    lines = files.read_lines(spark, str(tmp_path / "raw"))
    found = ingest.malformed(lines).collect()
    assert sorted((r.file[-6], r.line, r.reason) for r in found) == sorted((str(i), *b) for i in range(2) for b in bad.items())

    counts = ingest.import_lines(lines, str(tmp_path / "table"))
    assert counts["good_lines"] == 2 and counts["malformed_lines"] == 2 * len(bad)
    matches = ingest.imported(spark, str(tmp_path / "table"))
    expected = ingest.to_matches(ingest.parse_good_lines(lines))
    assert matches.columns == expected.columns
    assert sorted(map(str, matches.collect())) == sorted(map(str, expected.collect()))
    status = [r.real_match for r in classify.real_matches(expected).collect()]
    assert sum(counts[n] for n in ("abandoned", "safe_leave", "all_stayed")) == len(status)
    kept = ingest.quarantine(spark, str(tmp_path / "table")).collect()
    assert sorted((r.file, r.line, r.reason) for r in kept) == sorted((r.file, r.line, r.reason) for r in found)


def test_values_of_other_types(spark):
    """Converted as by a cast; what cannot be is null where malformed lines are tolerated, and else an error."""
    line = json.dumps(raw_match(1, [], duration="12", season=3.0, cluster=99999999999, radiant_win="maybe"))
    row = ingest.parse_good_lines(as_lines(spark, line)).first()
    assert (row.duration, row.season, row.cluster, row.radiant_win) == (12, 3, None, None)
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        ingest.parse_lines(as_lines(spark, line)).collect()


@pytest.mark.parametrize("read", ["ingest_matches", "parse_good_lines", "count_malformed", "malformed", "import_rows"])
def test_a_line_is_parsed_once(spark, read):
    plan = getattr(ingest, read)(as_lines(spark, raw_match(1, [])))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") + plan.count("from_json") == 1, plan


def test_gzip_csv_and_text_files(spark, tmp_path):
    path = tmp_path / "matches_0-30.gz"
    with gzip.open(path, "wt") as out:
        for i in range(3):
            out.write(json.dumps(raw_match(i, [raw_player(0, i)])) + "\n")
    lines = files.read_lines(spark, str(path))
    assert quality.count_lines(lines).first().lines == 3
    records = files.read_match_records(spark, str(path), "account_id")
    assert records.schema.simpleString() == "struct<match_id:bigint,players:array<struct<account_id:bigint>>>"
    assert [r.match_id for r in quality.matches_for_player(records, 2).collect()] == [2]

    triples = skill.as_triples(spark.createDataFrame([(1, 2, 0.5, 9)], "account_id long, hero_id int, score double, size long"))
    files.write_csv(triples, str(tmp_path / "triples"))
    assert files.read_triples(spark, str(tmp_path / "triples")).collect() == [(1, 2, 0.5, 9)]
    files.write_csv(triples, str(tmp_path / "headed"), header=True)
    assert files.read_csv(spark, str(tmp_path / "headed"), schemas.TRIPLES, header=True).count() == 1
    files.write_key_values(triples, "vec", "val", str(tmp_path / "pairs"))
    assert files.read_lines(spark, str(tmp_path / "pairs")).first().value == "2\t0.5"


def test_matches_by_day(spark, tmp_path):
    rows = ingest.ingest_matches(as_lines(spark, raw_match(1, []), raw_match(2, [], start_time=1_300_100_000)))
    files.write_matches(rows, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(str(r.day) for r in stored.collect()) == ["2011-03-13", "2011-03-14"]


def test_stream_imports_each_file_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(2):
        lines = as_lines(spark, *(raw_match(10 * number + i, [raw_player(0, i)]) for i in range(4)))
        lines.write.mode("append").text(source)
        import_new_files(spark, source, table, state).awaitTermination()
        import_new_files(spark, source, table, state).awaitTermination()
    assert sorted(r.match_id for r in spark.read.parquet(table).collect()) == [0, 1, 2, 3, 10, 11, 12, 13]


def test_dimensions(spark, tmp_path):
    path = tmp_path / "heroes.json"
    path.write_text('{"count": 2,\n "heroes": [{"name": "n1", "id": 1, "localized_name": "One"},\n {"id": 3, "localized_name": "Three"}]}')
    heroes = dimensions.hero_names(dimensions.read_document(spark, str(path)))
    assert sorted(map(tuple, heroes.collect())) == [(1, "One"), (3, "Three")]
    items = dimensions.item_names(spark.createDataFrame([('{"items": [{"id": 0, "name": "none"}]}',)], "value string"))
    assert items.collect() == [(0, "none")]


def test_lookup_is_broadcast_only_when_small(spark, monkeypatch):
    monkeypatch.setattr(dimensions, "MAX_LOOKUP_ROWS", 10)
    assert "broadcast" in dimensions.lookup(spark.range(10))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in dimensions.lookup(spark.range(11))._jdf.queryExecution().analyzed().toString()


def test_codes(spark):
    codes = spark.createDataFrame([(c,) for c in (-2, -1, 0, 5, 6, 7, 14, 15, None)], "c int")
    row = F.col("c")
    found = {
        r.c: (r.mode, r.lobby, r.leaver)
        for r in codes.select(
            "c",
            values.game_mode_name(row).alias("mode"),
            values.lobby_type_name(row).alias("lobby"),
            values.leaver_status_name(row).alias("leaver"),
        ).collect()
    }
    assert found[-2] == (None, None, None)
    assert found[-1] == (None, "INVALID", None)
    assert found[0] == ("UNKNOWN_ZERO", "PUBLIC_MATCHMAKING", "STAYED")
    assert found[5] == ("ALL_RANDOM", "TEAM_MATCH", "UNKOWN_FIVE")
    assert found[6] == ("UNKOWN_SIX", "SOLO_QUEUE", "UNKNOWN_SIX")
    assert found[7] == ("THE_DIRETIDE", None, "BOT")
    assert found[14] == ("COMPENDIUM", None, None)
    assert found[15] == (None, None, None)
    assert found[None] == (None, None, "BOT")


def test_slots_and_flags(spark):
    frame = spark.createDataFrame([(0,), (4,), (128,), (132,)], "s int")
    found = frame.select("s", values.team_slot(F.col("s")).alias("t"), values.is_radiant(F.col("s")).alias("r"))
    assert [tuple(r) for r in found.collect()] == [(0, 0, True), (4, 4, True), (128, 5, False), (132, 9, False)]
    row = spark.createDataFrame([(0b10000000001, 0b100001)], "t int, b int").select(
        *values.tower_flags(F.col("t")),
        values.towers_standing(F.col("t")).alias("towers"),
        *values.barracks_flags(F.col("b")),
        values.barracks_standing(F.col("b")).alias("barracks"),
    ).first()
    assert [n for n in fixed.TOWERS if row[n]] == ["top_t1", "bot_ancient"] and row.towers == 2
    assert [n for n in fixed.BARRACKS if row[n]] == ["top_melee", "bot_ranged"] and row.barracks == 2


GOOD = {"season": 1}


@pytest.mark.parametrize(
    ("changes", "player", "message"),
    [
        ({}, {}, None),
        ({"start_time": 1}, {}, "start_time was smaller then 1104537600000"),
        ({"start_time": 4_000_000_000}, {}, "start_time was larger then 1735689660000"),
        ({"tower_status_dire": 2049, "barracks_status_dire": 65}, {}, "dire_tower_status was larger then 2048"),
        ({"barracks_status_radiant": -1}, {}, "radiant_barracks_status was smaller then 0"),
        ({"lobby_type": 7, "game_mode": 15}, {}, "lobby_type unknown"),
        ({"game_mode": 15}, {}, "game_mode unknown"),
        ({"season": None}, {}, "season was null"),
        ({"duration": -1}, {"gold": 10001}, "duration was smaller then 0"),
        ({}, {"gold": 10001}, "gold was larger then 10000"),
        ({}, {"account_id": 4294967290}, "account_id was smaller then 0"),
        ({}, {"account_id": 4294967295}, None),
        ({}, {"leaver_status": 8}, "leaver_status unknown"),
        ({}, {"level": 26, "kills": 2000}, "kills was larger then 1000"),
        ({}, {"xp_per_min": 200000.5}, "exp_per_minute was larger then 200000"),
        ({}, {"ability_upgrades": [{"ability": 1, "time": 1, "level": 1}] * 26}, "ability upgrade size was larger then 25"),
        ({}, {"ability_upgrades": [{"ability": 1, "time": -1, "level": 1}]}, "ability upgrade time was smaller then 0"),
        ({}, {"hero_damage": 214748365}, "hero_damage was larger then 214748364"),
    ],
)
def test_validation_rules(spark, changes, player, message):
    players = [raw_player(0, 5), raw_player(1, **({"account_id": 6} | player))]
    matches = ingest.ingest_matches(as_lines(spark, raw_match(1, players, **(GOOD | changes))))
    found = [tuple(r) for r in quality.validate_matches(matches, 1735689600000).collect()]
    assert found == ([] if message is None else [(message, 1)])


def test_decode_players_without_names(spark):
    matches = ingest.ingest_matches(as_lines(spark, raw_match(1, [raw_player(130, 5, hero_id=99)])))
    heroes = spark.createDataFrame([(1, "one")], "hero_id int, name string")
    items = spark.createDataFrame([(1, "stick")], "item_id int, name string")
    found = decode.decode_players(matches, heroes, items).orderBy("position").collect()
    assert [r.item_slot for r in found] == fixed.ITEM_SLOTS
    assert {(r.hero_name, r.item_name, r.team_slot, r.radiant) for r in found} == {(None, "stick", 7, False)}


def test_jobs_from_files(spark, tmp_path):
    def path(name):
        return str(tmp_path / name)

    telemetry.raw_match_lines(telemetry.matches(spark, FOLDER)).write.text(path("raw"))
    jobs.run(spark, ["ingest_matches", "--lines", path("raw"), "--output", path("matches")])
    jobs.run(spark, ["player_timeline", "--matches", path("matches"), "--output", path("timeline")])
    jobs.run(spark, ["hero_win_rates", "--matches", path("matches"), "--interval", "86400", "--output", path("rates")])
    jobs.run(
        spark,
        ["multi_histogram", "--matches", path("matches"), "--columns", "game_mode,lobby_type",
         "--interval", "86400", "--output", path("counts"), "--format", "csv_header"],
    )
    jobs.run(spark, ["streak_win_rate", "--timeline", path("timeline"), "--burn_in", "1", "--output", path("streaks")])
    matches = spark.read.parquet(path("matches"))
    assert matches.count() == 100
    assert spark.read.option("header", True).csv(path("counts")).columns == ["field", "value", "start", "end", "count"]
    assert spark.read.parquet(path("streaks")).columns == ["streak", "win_rate", "games"]
    # A scan of the stored table reads only the nested fields it needs.
    plan = spark.read.parquet(path("matches")).select(F.explode("players.hero_id"))
    assert "array<struct<hero_id:int>>" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(SystemExit):
        jobs.run(spark, ["hero_win_rates", "--matches", path("matches"), "--output", path("x")])


def test_jobs_over_other_formats(spark, tmp_path):
    """Import by day, triples as text, key-value lines, and cells stored, put and read again."""
    def path(name):
        return str(tmp_path / name)

    telemetry.raw_match_lines(telemetry.matches(spark, FOLDER)).write.text(path("raw"))
    jobs.run(spark, ["ingest_matches", "--lines", path("raw"), "--output", path("days"), "--format", "by_day"])
    days = spark.read.parquet(path("days"))
    one = days.select("day").distinct().orderBy("day").first().day
    plan = days.where(F.col("day") == one)._jdf.queryExecution().executedPlan().toString()
    assert days.count() == 100 and "PartitionFilters: [isnotnull(day" in plan

    rows = [(i, v, float(i * v % 5), 9) for i in range(12) for v in (1, 2, 3)]
    files.write_csv(spark.createDataFrame(rows, schemas.TRIPLES), path("triples"))
    jobs.run(spark, ["tuple_correlations", "--triples", "csv:" + path("triples"), "--output", path("cor")])
    assert spark.read.parquet(path("cor")).count() == 3

    jobs.run(spark, ["compare_match_ids", "--lines", path("raw"), "--matches", path("days"), "--output", path("none"), "--format", "key_value"])
    assert files.read_lines(spark, path("none")).count() == 0

    stored = spark.createDataFrame([(1, "a", 5, 1.0), (1, "b", 5, 2.0)], "entity long, qualifier string, ts long, value double")
    cells.write(stored, path("cells"))
    stored.where("qualifier = 'a'").withColumn("value", F.lit(7.0)).write.parquet(path("puts"))
    jobs.run(spark, ["upsert_cells", "--stored", path("cells"), "--puts", path("puts"), "--output", path("after"), "--format", "cells"])
    jobs.run(spark, ["matching_cells", "--stored", path("after"), "--pattern", "a|c", "--output", path("matched")])
    assert [tuple(r) for r in cells.read(spark, path("matched")).collect()] == [(1, "a", 5, 7.0)]


def test_every_job_has_readable_parameters(spark):
    import typing

    for function in jobs.JOBS.values():
        for name, kind in typing.get_type_hints(function).items():
            assert name == "return" or callable(jobs._reader(kind, spark))


def test_hero_cells_are_cells(spark):
    rates = spark.createDataFrame([(1, 5, 2.0, 0.5)], "hero_id int, slot_ms long, games_played double, win_rate double")
    from matchlake.operators import herostats

    found = cells.matching(herostats.hero_cells(rates, 60), "win_rate_.*").collect()
    assert [tuple(r) for r in found] == [(1, "win_rate_60", 5, 0.5)]
    named = {r.qualifier for r in herostats.sliding_cells(rates, 10800, 8).collect()}
    assert named == {"win_rate_average_86400", "games_played_average_86400"}
