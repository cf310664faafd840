"""Joining a table with hot keys to a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this share of the rows on, so fewer than HOT_SHARE keys can be hot and what
# is broadcast for them has a bound that does not follow the data.
HOT_SHARE = 10_000
# Rows of one key that one task may join, if the key is hot.
KEY_SLICE = 200_000


def hot_keys(counts: DataFrame, least: int = 2) -> DataFrame:
    """The rows of ``counts`` (key, rows, ...) that hold 1 / HOT_SHARE of all rows or more."""
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    return counts.filter((F.col("rows") >= least) & (F.col("rows") * F.lit(HOT_SHARE) >= total))


def map_side_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join of ``big`` with narrow rows of ``small`` (key, rows, ...), one per key.

    ``rows`` is how many rows of ``big`` have the key. Rows with a hot key meet a broadcast of
    fewer than HOT_SHARE rows and are not shuffled; the others hold no hot key.
    """
    hot = F.broadcast(hot_keys(small))
    cold = big.join(hot.select(key), key, "left_anti").join(small, key)
    return big.join(hot, key).unionByName(cold)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    rows_per_slice: int = KEY_SLICE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``big`` join ``small`` on ``key``, with hot keys of ``big`` cut into slices.

    For rows of ``small`` too wide to broadcast: a hot key's rows are spread by a hash of
    ``spread_by``, and its one row of ``small`` is repeated for every slice. ``how`` is inner or
    left. ``counts`` (key, rows) saves counting ``big`` again.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    number = F.ceil(F.col("rows") / F.lit(rows_per_slice)).cast("int")
    hot = F.broadcast(
        hot_keys(counts, rows_per_slice + 1).select(key, number.alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    left = big.join(hot, key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int")
    )
    right = small.join(hot, key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - F.lit(1)))
    )
    joined = left.drop("_slices").join(right.drop("_slices"), [key, "_slice"], how)
    return joined.drop("_slice")
