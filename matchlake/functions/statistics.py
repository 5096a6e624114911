"""Closed forms over sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_spread(length: Column, present: Column, mean: Column, spread: Column) -> Column:
    """Sum of squares around the mean of a vector whose absent values are 0.

    ``mean`` and ``spread`` are those of the present values, so that large values with small
    differences keep their differences.
    """
    return spread + mean * mean * present * (length - present) / length


def padded_product(
    length: Column, shared: Column, covariance: Column, shared1: Column, shared2: Column,
    present1: Column, present2: Column, mean1: Column, mean2: Column,
) -> Column:
    """Sum of products around the means of two vectors whose absent values are 0.

    ``covariance`` is the sum of products around the means over the shared indexes,
    ``shared1`` and ``shared2`` are the means there.
    """
    whole1, whole2 = mean1 * present1 / length, mean2 * present2 / length
    both = covariance + shared * (shared1 - whole1) * (shared2 - whole2)
    # Without values of its own a vector adds exactly nothing here.
    alone1 = F.when(present1 == shared, 0.0).otherwise(present1 * mean1 - shared * shared1 - (present1 - shared) * whole1)
    alone2 = F.when(present2 == shared, 0.0).otherwise(present2 * mean2 - shared * shared2 - (present2 - shared) * whole2)
    neither = (length - present1 - present2 + shared) * whole1 * whole2
    return both - whole2 * alone1 - whole1 * alone2 + neither


def pearson(product: Column, spread1: Column, spread2: Column) -> Column:
    """Pearson's r from sums around the means; null where either side does not vary."""
    varies = (spread1 > 0) & (spread2 > 0)
    return F.when(varies, product / F.sqrt(spread1) / F.sqrt(spread2))


def pearson_of(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate over rows; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
