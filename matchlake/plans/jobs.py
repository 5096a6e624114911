"""Command-line jobs: tables and typed arguments in, one table out.

    spark-submit -m matchlake hero_win_rates --matches <parquet> --interval 10800 --output <path>

The arguments of a job are the parameters of its function below. A ``Table`` is a
parquet path, ``Cells`` one of stored cells (behind ``store:`` a store that takes puts), ``Lines`` a path of text lines, ``Document``
a JSON file. ``Triples`` are a parquet path, or comma-separated text behind ``csv:``.
Results are written as parquet, as CSV, as ``by_day`` folders of matches, as folders ``by_outcome``
of an import, as ``cells`` in a folder for each qualifier, as puts into a ``cell_store``, or as ``key_value`` lines of their first two columns.
"""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable
from typing import NewType, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from ..operators import (
    classify,
    clusters,
    correlation,
    decode,
    derive,
    herostats,
    histogram,
    ingest,
    picks,
    quality,
    skill,
    timeline,
)
from ..schemas import narrow_raw_match
from ..session import STARTUP_CONF, configure
from ..sources import cell_store, cells, dimensions, files
from . import chains

Table = NewType("Table", DataFrame)
Cells = NewType("Cells", DataFrame)
Triples = NewType("Triples", DataFrame)
Lines = NewType("Lines", DataFrame)
Document = NewType("Document", DataFrame)
Names = NewType("Names", list)

FORMATS = ("parquet", "csv", "csv_header", "by_day", "by_outcome", "cells", "cell_store", "key_value")

JOBS: dict[str, Callable[..., DataFrame]] = {}


def job(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    JOBS[function.__name__] = function
    return function


# --- tables -----------------------------------------------------------------------------


@job
def ingest_matches(lines: Lines) -> DataFrame:
    return ingest.ingest_matches(lines)


@job
def ingest_player_matches(lines: Lines) -> DataFrame:
    return ingest.ingest_player_matches(lines)


@job
def good_matches(lines: Lines) -> DataFrame:
    return ingest.to_matches(ingest.parse_good_lines(lines))


@job
def import_lines(lines: Lines) -> DataFrame:
    """Matches and malformed lines, for the ``by_outcome`` format."""
    return ingest.import_rows(lines)


@job
def quarantine(lines: Lines) -> DataFrame:
    return ingest.malformed(lines)


@job
def count_malformed(lines: Lines) -> DataFrame:
    return ingest.count_malformed(lines)


@job
def hero_names(document: Document) -> DataFrame:
    return dimensions.hero_names(document)


@job
def item_names(document: Document) -> DataFrame:
    return dimensions.item_names(document)


@job
def real_match(matches: Table, ts: int = 0) -> DataFrame:
    return classify.real_matches(matches, ts)


@job
def real_match_counters(matches: Table) -> DataFrame:
    return classify.real_match_counters(matches)


@job
def derive_real_match(matches: Table) -> DataFrame:
    return derive.with_derived(matches, real_match=classify.real_match_status())


@job
def transfer_derived(matches: Table, regex: str = ".*") -> DataFrame:
    return derive.transfer(matches, regex)


@job
def player_timeline(matches: Table) -> DataFrame:
    return derive.player_timeline(matches)


@job
def games_played(timeline: Table, ts: int = 0) -> DataFrame:
    return derive.games_played(timeline, ts)


@job
def upsert_cells(stored: Cells, puts: Cells) -> DataFrame:
    return cells.upsert(stored, puts)


@job
def matching_cells(stored: Cells, pattern: str) -> DataFrame:
    return cells.matching(stored, pattern)


@job
def hero_cells(rates: Table, interval: int) -> DataFrame:
    return herostats.hero_cells(rates, interval)


@job
def latest_cells(stored: Table) -> DataFrame:
    return cells.latest(stored)


# --- heroes -----------------------------------------------------------------------------


@job
def hero_win_rates(matches: Table, interval: int, min_status: float = 1.0) -> DataFrame:
    return herostats.hero_win_rates(matches, interval, min_status)


@job
def sliding_hero_win_rates(
    rates: Table, start_interval: int, window_size: int, window_step: int, min_games: float
) -> DataFrame:
    return herostats.sliding_hero_win_rates(
        rates, start_interval, window_size, window_step, min_games
    )


@job
def hero_skill_raw(timeline: Table, drop_first: int, min_games: int) -> DataFrame:
    return skill.hero_skill_raw(timeline, drop_first, min_games)


@job
def hero_skill_adjusted(
    timeline: Table, rates: Table, interval: int, drop_first: int, min_games: int
) -> DataFrame:
    return skill.hero_skill_adjusted(timeline, rates, interval, drop_first, min_games)


@job
def skill_triples(skill_table: Table) -> DataFrame:
    return skill.as_triples(skill_table)


@job
def tuple_correlations(triples: Triples, size_filter: int = 0) -> DataFrame:
    return correlation.shared_correlations(triples, size_filter)


@job
def pick_correlations(
    timeline: Table, num_players: int, size_filter: int, first_hero: int = 1, last_hero: int = 104
) -> DataFrame:
    triples = picks.pick_triples(timeline, size_filter)
    return correlation.range_correlations(triples, num_players, first_hero, last_hero)


@job
def present_correlations(triples: Table, vector_length: int) -> DataFrame:
    return correlation.present_correlations(triples, vector_length)


@job
def matrix_correlations(triples: Table, vector_length: int) -> DataFrame:
    return correlation.matrix_correlations(triples, vector_length)


@job
def named_correlations(correlations: Table, heroes: Table, min_size: int | None = None) -> DataFrame:
    return correlation.named_correlations(correlations, heroes, min_size)


@job
def player_row_numbers(timeline: Table, size_filter: int) -> DataFrame:
    return picks.player_row_numbers(timeline, size_filter)


@job
def hero_pick_share(timeline: Table, row_numbers: Table) -> DataFrame:
    return picks.hero_pick_share(timeline, row_numbers)


@job
def pick_vectors(shares: Table) -> DataFrame:
    return picks.pick_vectors(shares)


@job
def hero_clusters(shares: Table, heroes: Table, k: int = 10, iterations: int = 2) -> DataFrame:
    return clusters.name_clusters(clusters.hero_clusters(shares, k, iterations), heroes)


@job
def hero_clustering(
    timeline: Table, heroes: Table, size_filter: int = 15, k: int = 10, iterations: int = 2
) -> DataFrame:
    return chains.hero_clustering(
        timeline, heroes, size_filter=size_filter, k=k, iterations=iterations
    )


# --- player timelines -------------------------------------------------------------------


@job
def streak_values(timeline: Table, burn_in: int = 12) -> DataFrame:
    return _timeline.streak_values(timeline, burn_in)


@job
def streak_win_rate(timeline: Table, burn_in: int = 12) -> DataFrame:
    return _timeline.streak_win_rate(timeline, burn_in)


@job
def win_rate_vs_games(timeline: Table, window_size: int) -> DataFrame:
    return _timeline.win_rate_vs_games(timeline, window_size)


@job
def group_win_rate(timeline: Table, column: str) -> DataFrame:
    return _timeline.group_win_rate(timeline, column)


# Parameters above are called ``timeline`` too.
_timeline = timeline

# --- histograms -------------------------------------------------------------------------


@job
def winner_rax_counts(matches: Table) -> DataFrame:
    return histogram.winner_rax_percent(histogram.winner_rax_counts(matches))


@job
def value_histogram(matches: Table, column: str, interval: int) -> DataFrame:
    return histogram.histogram(matches, column, interval)


@job
def multi_histogram(matches: Table, columns: Names, interval: int) -> DataFrame:
    return histogram.multi_histogram(matches, columns, interval)


@job
def value_histogram_nulls(matches: Table, columns: Names, interval: int = 21600) -> DataFrame:
    keys = [histogram.value_key("data", c, interval) for c in columns]
    return histogram.key_histogram(matches, *keys)


@job
def weekly_histogram(counts: Table) -> DataFrame:
    return histogram.weekly_histogram(counts)


@job
def weekly_histogram_wide(weekly: Table, field: str) -> DataFrame:
    return histogram.weekly_histogram_wide(weekly, field)


# --- integrity checks -------------------------------------------------------------------


@job
def validate_matches(matches: Table, as_of_ms: int) -> DataFrame:
    return quality.validate_matches(matches, as_of_ms)


@job
def compare_match_ids(lines: Lines, matches: Table) -> DataFrame:
    return quality.compare_match_ids(ingest.parse_lines(lines, narrow_raw_match()), matches)


@job
def compare_player_counts(lines: Lines, player_matches: Table) -> DataFrame:
    records = ingest.parse_lines(lines, narrow_raw_match("account_id"))
    return quality.compare_player_counts(records, player_matches)


@job
def count_unique_match_ids(lines: Lines) -> DataFrame:
    return quality.count_unique_match_ids(ingest.parse_lines(lines, narrow_raw_match()))


@job
def count_lines(lines: Lines) -> DataFrame:
    return quality.count_lines(lines)


@job
def count_cells(table: Table, column: str) -> DataFrame:
    return quality.count_cells(table, column)


@job
def matches_for_player(lines: Lines, player_id: int) -> DataFrame:
    records = ingest.parse_lines(lines, narrow_raw_match("account_id"))
    return quality.matches_for_player(records, player_id)


@job
def max_account_id(lines: Lines) -> DataFrame:
    return quality.max_account_id(ingest.parse_good_lines(lines, narrow_raw_match("account_id")))


@job
def example_values(matches: Table, field: str = "leaver_status", examples: int = 10) -> DataFrame:
    return quality.example_summaries(quality.example_values(matches, field, examples))


@job
def sequence_gaps(names: Lines) -> DataFrame:
    return quality.sequence_gaps(names.withColumnRenamed("value", "file_name"))


@job
def decode_matches(matches: Table) -> DataFrame:
    return decode.decode_matches(matches)


@job
def decode_players(matches: Table, heroes: Table, items: Table) -> DataFrame:
    return decode.decode_players(matches, heroes, items)


# --- running ----------------------------------------------------------------------------


def _cells(spark: SparkSession, path: str) -> DataFrame:
    stored = path.removeprefix("store:")
    return cells.read(spark, path) if stored == path else cell_store.CellStore(spark, stored).read()


def _triples(spark: SparkSession, path: str) -> DataFrame:
    text = path.removeprefix("csv:")
    return spark.read.parquet(path) if text == path else files.read_triples(spark, text)


def _write(result: DataFrame, output: str, kind: str) -> None:
    if kind == "parquet":
        result.write.mode("errorifexists").parquet(output)
    elif kind == "by_day":
        files.write_matches(result, output)
    elif kind == "by_outcome":
        result.write.mode("errorifexists").partitionBy("good").parquet(output)
    elif kind == "cells":
        cells.write(result, output)
    elif kind == "cell_store":
        cell_store.CellStore(result.sparkSession, output).put(result)
    elif kind == "key_value":
        files.write_key_values(result, *result.columns[:2], output)
    else:
        files.write_csv(result, output, header=kind == "csv_header")


def _reader(kind: object, spark: SparkSession) -> Callable[[str], object]:
    if kind is Table:
        return spark.read.parquet
    if kind is Cells:
        return lambda path: _cells(spark, path)
    if kind is Triples:
        return lambda path: _triples(spark, path)
    if kind is Lines:
        return lambda path: files.read_lines(spark, path)
    if kind is Document:
        return lambda path: dimensions.read_document(spark, path)
    if kind is Names:
        return lambda text: text.split(",")
    if kind == int | None:
        return int
    return kind


def run(spark: SparkSession, arguments: list[str]) -> None:
    """Run one job: its name, then ``--parameter value`` pairs and the output."""
    parser = argparse.ArgumentParser(prog="matchlake")
    parser.add_argument("job", choices=sorted(JOBS))
    chosen = parser.parse_args(arguments[:1]).job
    function = JOBS[chosen]
    hints = get_type_hints(function)
    options = argparse.ArgumentParser(prog=f"matchlake {chosen}")
    for name, parameter in inspect.signature(function).parameters.items():
        required = parameter.default is inspect.Parameter.empty
        options.add_argument(
            f"--{name}",
            type=_reader(hints[name], spark),
            required=required,
            default=None if required else parameter.default,
        )
    options.add_argument("--output", required=True)
    options.add_argument("--format", choices=FORMATS, default="parquet")
    values = vars(options.parse_args(arguments[1:]))
    output, kind = values.pop("output"), values.pop("format")
    _write(function(**values), output, kind)


def main(arguments: list[str]) -> None:
    spark = configure(
        SparkSession.builder.appName("matchlake").config(map=STARTUP_CONF).getOrCreate()
    )
    run(spark, arguments)
