"""k-means with Manhattan distance over sparse pick vectors.

Vectors and centroids stay tables of entries per player row. With absent entries being 0,

    sum |x - c| = sum |x| + sum |c| + sum over shared rows (|x - c| - |x| - |c|)

so a distance needs a join on the shared rows only. The first sum is the same
for all clusters and is left out when they are compared.

Shares are counted in whole UNITS and a centroid keeps the total of its members, so sums are
exact: equal distances are equal, whatever the order of the rows.

Entries and centroids are tables bucketed by player row. Distances, means and the next
centroids all keep that layout, so an iteration moves no entries between
tasks, only one partial sum per task, hero and cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BucketedTables, checkpoint
from ..sources.dimensions import lookup

# Steps of a share. Distances are exact for clusters of fewer than 10,000 members.
UNITS = 10**12


def _assign(shares: DataFrame, heroes: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(hero_id, cluster): the nearest centroid, the lowest cluster among equals.

    Distances are multiplied by the members of the cluster, m |x - c| = |m x - total|, and
    divided by them once they are summed.
    """
    whole = "decimal(20, 0)"
    x, total = F.col("members") * F.col("units"), F.col("total")
    shared = shares.join(centroids, "player_row").select(
        "hero_id", "cluster", (F.abs(x - total) - F.abs(x) - F.abs(total)).cast(whole).alias("shared")
    )
    # A hero that shares no row with a cluster still has a distance to it.
    every_cluster = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    nothing = heroes.select("hero_id", every_cluster.alias("cluster"), F.lit(0).cast(whole).alias("shared"))
    sums = shared.unionByName(nothing).groupBy("hero_id", "cluster").agg(F.sum("shared").alias("sum"))
    # One row per cluster, and k is an argument.
    norms = centroids.groupBy("cluster").agg(
        F.sum(F.abs("total").cast(whole)).alias("norm"), F.first("members").cast("decimal(10, 0)").alias("size")
    )
    distance = (F.col("norm") + F.col("sum")) / F.col("size")
    return (
        sums.join(F.broadcast(norms), "cluster")
        .groupBy("hero_id")
        .agg(F.min_by("cluster", F.struct(distance, "cluster")).alias("cluster"))
    )


def _centroids(shares: DataFrame, members: DataFrame, previous: DataFrame) -> DataFrame:
    """Total vector and members per cluster; a cluster without members keeps its centroid."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
    totals = (
        shares.join(members, "hero_id")
        .groupBy("cluster", "player_row")
        .agg(F.sum("units").alias("total"))
        .join(F.broadcast(sizes), "cluster")
    )
    kept = previous.join(F.broadcast(sizes.select("cluster")), "cluster", "left_anti")
    columns = ["cluster", "player_row", "total", "members"]
    return totals.select(*columns).unionByName(kept.select(*columns))


def hero_clusters(shares: DataFrame, k: int, iterations: int) -> DataFrame:
    """(hero_id, cluster) after ``iterations`` updates from the ``k`` lowest heroes."""
    units = F.round(F.col("share") * UNITS).cast("long").alias("units")
    with BucketedTables(shares.sparkSession, "player_row") as tables:
        entries = shares.select("hero_id", "player_row", units).repartition(tables.buckets, "player_row")
        entries = tables.write(entries)
        heroes = checkpoint(entries.select("hero_id").distinct())
        lowest = heroes.orderBy("hero_id").limit(k)
        number = F.row_number().over(Window.orderBy("hero_id")) - 1
        seeds = lowest.select("hero_id", number.alias("cluster"))
        centroids = entries.join(F.broadcast(seeds), "hero_id").select(
            "cluster", "player_row", F.col("units").alias("total"), F.lit(1).cast("long").alias("members")
        )
        for _ in range(iterations):
            members = lookup(checkpoint(_assign(entries, heroes, centroids, k)))
            centroids = tables.write(_centroids(entries, members, centroids))
        return checkpoint(_assign(entries, heroes, centroids, k))


def name_clusters(assigned: DataFrame, heroes: DataFrame) -> DataFrame:
    """Names of each cluster's heroes, in one line per cluster."""
    names = lookup(heroes.select("hero_id", "name"))
    named = assigned.join(names, "hero_id", "left").withColumn(
        "name", F.coalesce("name", F.lit("UNKNOWN"))
    )
    # Heroes are a small catalogue: a cluster's list is bounded by it.
    return named.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.concat_ws(", ", F.sort_array(F.collect_list("name"))).alias("heroes"),
    )
