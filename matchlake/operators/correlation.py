"""Correlations between sparse vectors given as (index, vec, val) triples.

A triple is unique per (index, vec). Indexes are players; vectors are heroes or another
catalogue with integer ids. The product of the triples with themselves is partitioned by
blocks: the values of an index are cut into blocks of at most BLOCK vectors, and each two
blocks meet under a key of their own. An index with no more than BLOCK vectors is one block,
so one shuffle of the triples and no join pair its values. The blocks of a longer one are
shuffled once more, each to the blocks of its index, so that its pairs, whose number is
quadratic, are spread over tasks. The sums per pair are combined per task before they are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import padded_product, padded_spread, pearson, pearson_of
from ..sources.dimensions import lookup


# Vectors of an index that are paired in one row.
BLOCK = 512


def _block_pairs(lists: DataFrame, block: int) -> DataFrame:
    """(lows, highs): each two blocks of a list of values, and each block with itself.

    A block is sent to the keys (index, lower block, upper block) that it takes part in.
    """
    number = F.ceil(F.size("values") / F.lit(block)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), number - 1),
        lambda i: F.slice(F.sort_array("values"), i * F.lit(block) + 1, F.lit(block)),
    )
    rows = lists.select("index", number.alias("number"), F.posexplode(cut).alias("place", "part"))
    others = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    met = others.groupBy(
        "index", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j")
    ).agg(F.min_by("part", "place").alias("lows"), F.max_by("part", "place").alias("highs"))
    return met.select("lows", "highs")


def _pairs(triples: DataFrame) -> DataFrame:
    """Values of two vectors, ``lower`` < ``upper``, at each index they share."""
    known = triples.where(F.col("index").isNotNull() & F.col("vec").isNotNull())
    lists = known.groupBy("index").agg(F.collect_list(F.struct("vec", F.col("val"))).alias("values"))
    short = lists.where(F.size("values").between(2, BLOCK))
    blocks = short.select(F.col("values").alias("lows"), F.col("values").alias("highs")).unionByName(
        _block_pairs(lists.where(F.size("values") > BLOCK), BLOCK)
    )
    firsts = blocks.select("highs", F.explode("lows").alias("low"))
    above = F.filter("highs", lambda v: v["vec"] > F.col("low.vec"))
    return firsts.select("low", F.explode(above).alias("up")).select(
        F.col("low.vec").alias("lower"),
        F.col("low.val").alias("x"),
        F.col("up.vec").alias("upper"),
        F.col("up.val").alias("y"),
    )


def shared_correlations(triples: DataFrame, size_filter: int | None = None) -> DataFrame:
    """Pearson over the indexes two vectors share, with their number.

    With ``size_filter``, triples of that size or smaller are left out first.
    """
    if size_filter is not None:
        triples = triples.where(F.col("size") > size_filter)
    return (
        _pairs(triples)
        .groupBy(F.col("lower").alias("vec"), F.col("upper").alias("vec2"))
        .agg(pearson_of(F.col("x"), F.col("y")).alias("cor"), F.count("*").alias("size"))
    )


def _vector_sums(triples: DataFrame) -> DataFrame:
    """Present values of each vector: their number, mean, and sum of squares around it."""
    present = F.count("val").cast("double")
    return triples.groupBy("vec").agg(
        present.alias("present"), F.avg("val").alias("mean"), (F.var_pop("val") * present).alias("spread")
    )


def _shared_sums(triples: DataFrame) -> DataFrame:
    """Shared values of each pair: their number, means, and sum of products around them."""
    shared = F.count("*").cast("double")
    return (
        _pairs(triples)
        .groupBy(F.col("upper").alias("vec1"), F.col("lower").alias("vec2"))
        .agg(
            shared.alias("shared"),
            F.avg("y").alias("shared1"),
            F.avg("x").alias("shared2"),
            (F.covar_pop("x", "y") * shared).alias("covariance"),
        )
    )


def _side(sums: DataFrame, number: int) -> DataFrame:
    return sums.select(*[F.col(c).alias(f"{c}{number}") for c in ("vec", "present", "mean", "spread")])


def _length(vector_length: int | Column) -> Column:
    length = vector_length if isinstance(vector_length, Column) else F.lit(vector_length)
    return length.cast("double")


def _correlate(pairs: DataFrame, vector_length: int | Column) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(name, F.lit(0.0))

    n = _length(vector_length)
    spreads = [padded_spread(n, known(f"present{k}"), known(f"mean{k}"), known(f"spread{k}")) for k in (1, 2)]
    product = padded_product(
        n, known("shared"), known("covariance"), known("shared1"), known("shared2"),
        known("present1"), known("present2"), known("mean1"), known("mean2"),
    )
    return pairs.select("vec1", "vec2", pearson(product, *spreads).alias("cor"))


def range_correlations(
    triples: DataFrame, vector_length: int | Column, first: int, last: int
) -> DataFrame:
    """Pearson of vectors of a given length, absent values being 0.

    Covers the pairs of ids in ``first..last`` of which at least one vector has
    a value. Sums per vector and products per pair suffice, so the zeros are
    never written out.
    """
    wanted = triples.where(F.col("vec").between(first, last))
    sums = _vector_sums(wanted)
    ids = triples.sparkSession.range(first + 1, last + 1).select(F.col("id").cast("int").alias("vec1"))
    grid = ids.withColumn("vec2", F.explode(F.sequence(F.lit(first), F.col("vec1") - 1)))
    pairs = (
        grid.join(_side(sums, 1), "vec1", "left")
        .join(_side(sums, 2), "vec2", "left")
        .where(F.col("present1").isNotNull() | F.col("present2").isNotNull())
        .join(_shared_sums(wanted), ["vec1", "vec2"], "left")
    )
    return _correlate(pairs, vector_length)


def present_correlations(triples: DataFrame, vector_length: int | Column) -> DataFrame:
    """As :func:`range_correlations`, over the vectors that are present."""
    sums = _vector_sums(triples)
    # The catalogue bounds the list of present vectors, whatever the range of their ids.
    present = sums.agg(F.collect_list("vec")).scalar()
    pairs = (
        _side(sums, 1)
        .withColumn("vec2", F.explode(present))
        .where(F.col("vec1") > F.col("vec2"))
        .join(_side(sums, 2), "vec2")
        .join(_shared_sums(triples), ["vec1", "vec2"], "left")
    )
    return _correlate(pairs, vector_length)


def matrix_correlations(triples: DataFrame, vector_length: int | Column) -> DataFrame:
    """Row-normalised sparse matrix times its transpose, over the vector length.

    Mean and deviation take the vector length as count but sum over the present
    values only, so this differs from Pearson. Pairs sharing no index are absent.
    """
    n = _length(vector_length)
    whole = F.col("mean") * F.col("present") / n
    around = F.col("spread") + F.col("present") * (F.col("mean") - whole) * (F.col("mean") - whole)
    stats = _vector_sums(triples).select("vec", whole.alias("whole"), F.sqrt(around / n).alias("deviation"))
    pairs = _shared_sums(triples)
    for k in (1, 2):
        side = stats.select(*[F.col(c).alias(f"{c}{k}") for c in stats.columns])
        pairs = pairs.join(side, f"vec{k}")
    # Means and deviations are those of the vectors, so the triples need no join.
    offset = F.col("shared") * (F.col("shared1") - F.col("whole1")) * (F.col("shared2") - F.col("whole2"))
    scale = F.col("deviation1") * F.col("deviation2") * n
    return pairs.select("vec1", "vec2", F.try_divide(F.col("covariance") + offset, scale).alias("cor"))


def named_correlations(
    correlations: DataFrame, heroes: DataFrame, min_size: int | None = None
) -> DataFrame:
    """Correlations (vec, vec2, cor, size) with hero names, weakest first.

    Undefined ones are dropped, unknown heroes are called UNKNOWN.
    """
    defined = correlations.where(F.col("cor").isNotNull() & ~F.isnan("cor"))
    if min_size is not None:
        defined = defined.where(F.col("size") > min_size)
    unknown = F.lit("UNKNOWN")
    for vec, hero in (("vec", "hero"), ("vec2", "hero2")):
        names = heroes.select(F.col("hero_id").alias(vec), F.col("name").alias(hero))
        defined = defined.join(lookup(names), vec, "left").withColumn(
            hero, F.coalesce(hero, unknown)
        )
    rest = [c for c in ("cor", "size") if c in correlations.columns]
    return defined.select("hero", "hero2", *rest).orderBy(F.abs("cor"))
