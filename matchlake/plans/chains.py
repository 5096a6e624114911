"""Analyses that run several jobs in a row, as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clusters, correlation, herostats, histogram, picks, skill


def skill_correlation(
    matches: DataFrame,
    timeline: DataFrame,
    heroes: DataFrame,
    *,
    start_interval: int = 10800,
    window_size: int = 57,
    window_step: int = 8,
    slot_min_games: float = 6000,
    drop_first: int = 12,
    min_games: int = 1,
    size_filter: int = 10,
    order: str = "ts",
    time_ms: str = "ts",
) -> DataFrame:
    """Which heroes' skill goes together, against smoothed hero win rates."""
    rates = herostats.hero_win_rates(matches, start_interval)
    smoothed = herostats.sliding_hero_win_rates(
        rates, start_interval, window_size, window_step, slot_min_games
    )
    scores = skill.hero_skill_adjusted(
        timeline, smoothed, start_interval * window_step, drop_first, min_games, order, time_ms
    )
    pairs = correlation.shared_correlations(skill.as_triples(scores), size_filter)
    return correlation.named_correlations(pairs, heroes)


def hero_clustering(
    timeline: DataFrame, heroes: DataFrame, *, size_filter: int = 15, k: int = 10, iterations: int = 2
) -> DataFrame:
    """Heroes that the same players pick, by name."""
    rows = picks.player_row_numbers(timeline, size_filter)
    shares = picks.hero_pick_share(timeline, rows)
    return clusters.name_clusters(clusters.hero_clusters(shares, k, iterations), heroes)


def weekly_counts(matches: DataFrame, columns: list[str], interval: int = 86400) -> DataFrame:
    """Weekly counts of each value of the columns."""
    return histogram.weekly_histogram(histogram.multi_histogram(matches, columns, interval))
