"""Ordering operators: top-n, per-key winners, global positions, strides, quantiles.

Two kinds of plan are used, and the choice is by the size of what is kept:

* a cut (top-n, top-k per group, first or last per key) keeps a bounded number of
  rows per group, so Spark trims on the map side (``TakeOrderedAndProject``,
  ``WindowGroupLimit``, partial aggregation) and a hot group never travels whole;
* a position for every row (:func:`positions`) is a distributed sort with offsets,
  so neither the whole table nor a hot group has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.durable import durable

# Spark only rewrites row_number() <= k into a map-side limit up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold); larger cuts use positions().
GROUP_LIMIT = 1000


class TooFewRows(ValueError):
    """A cut asked for more rows than exist."""


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows with their 1-based rank."""
    if n > GROUP_LIMIT:
        return positions(df, order, rank=rank).filter(F.col(rank) <= n)
    kept = df.orderBy(*order).limit(n)
    # The unpartitioned window sees the n kept rows only.
    return kept.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """Fail unless the cut is full. ``df`` has at most ``n`` rows."""
    found = df.count()
    if found < n:
        raise TooFewRows(f"only {found} of {n} rows passed the filter")
    return df


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group, trimmed before the shuffle."""
    if k > GROUP_LIMIT:
        return positions(df, order, group, rank).filter(F.col(rank) <= k)
    window = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window).cast("bigint"))
    return numbered.filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first record of every key; rows without a key are dropped."""
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return top_per_group(keyed, [key], order, 1, "_first").drop("_first")


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The latest record of every key (partial ``max_by`` before the shuffle)."""
    others = [name for name in df.columns if name != key]
    packed = F.max_by(F.struct(*[F.col(name) for name in others]), order).alias("_last")
    latest = df.groupBy(key).agg(packed)
    return latest.select(*[
        F.col(name) if name == key else F.col(f"_last.`{name}`") for name in df.columns
    ])


def _sorted_slices(
    df: DataFrame, order: Sequence[Column], group: Sequence[str]
) -> DataFrame:
    """``df`` range-sorted on (group, order), with ``_stamp`` and its ``_part``.

    The stamp holds the range partition in its upper bits and the row in its lower
    33, so stamps grow in sort order. The result is checkpointed, because stamps must
    not change when an executor is lost.
    """
    keys = [F.col(name) for name in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stamped = durable(ranged.withColumn("_stamp", F.monotonically_increasing_id()))
    return stamped.withColumn("_part", F.shiftright("_stamp", 33))


def _earlier(slices: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of a group's earlier slices: one row per partition a group touches."""
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    return slices.withColumns(
        {name: F.coalesce(F.sum(name).over(before), F.lit(0)) for name in sums}
    )


def _join_slices(stamped: DataFrame, slices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every row next to the totals of its own slice."""
    keyed = slices.withColumnsRenamed({name: f"_of_{name}" for name in [*group, "_part"]})
    if not group:
        # At most one row per range partition.
        keyed = F.broadcast(keyed)
    on = F.col("_part") == F.col("_of__part")
    for name in group:
        on = on & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return stamped.join(keyed, on, "inner")


def positions(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """1-based row number in ``order`` within ``group``, for every row.

    ``row_number()`` over an unpartitioned or a skewed window would sort a whole
    table (or a hot group) in one task. Here a group may span any number of range
    partitions: a row's place is its place in the partition plus the size of the
    group's slices in earlier partitions. ``order`` must be total.
    """
    stamped = _sorted_slices(df, order, group)
    slices = stamped.groupBy(*group, "_part").agg(
        F.min("_stamp").alias("_start"), F.count(F.lit(1)).alias("_before")
    )
    joined = _join_slices(stamped, _earlier(slices, group, ["_before"]), group)
    place = F.col("_stamp") - F.col("_start") + F.col("_before") + F.lit(1)
    return joined.select(*df.columns, place.alias(rank))


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Running sums (up to and including each row) of integer columns within ``group``.

    The in-partition part is a window over one slice, which is never more than a
    range partition; earlier slices come in as offsets.
    """
    names = list(totals)
    valued = df.withColumns({f"_v_{n}": c.cast("bigint") for n, c in totals.items()})
    stamped = _sorted_slices(valued, order, group)
    slices = stamped.groupBy(*group, "_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names]
    )
    joined = _join_slices(stamped, _earlier(slices, group, [f"_b_{n}" for n in names]), group)
    so_far = (
        Window.partitionBy(*group, "_part").orderBy("_stamp")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *df.columns,
        *[(F.sum(f"_v_{n}").over(so_far) + F.col(f"_b_{n}")).alias(n) for n in names],
    )


def stride(
    ranked: DataFrame, total: int | Column, low: float, high: float, count: int
) -> DataFrame:
    """``count`` evenly spaced rows from the rank window [low, high) of ``total`` rows."""
    return ranked.filter(in_stride(F.col("rank"), total, low, high, count))


def in_stride(
    rank: Column, total: int | Column, low: float, high: float, count: int
) -> Column:
    total = total if isinstance(total, Column) else F.lit(total)
    start = F.floor(total * F.lit(float(low))).cast("bigint")
    stop = F.floor(total * F.lit(float(high))).cast("bigint")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor((stop - start) / F.lit(max(count, 1))))
    offset = rank - F.lit(1) - start
    return (
        F.lit(count > 0)
        & (offset >= 0)
        & (rank - F.lit(1) < stop)
        & (offset % step == 0)
        & (F.floor(offset / step) < count)
    )


def lower_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the value at position int(q * (n - 1)) of the sorted values."""
    ranked = positions(df.select(value), [F.col(value).asc()], rank="_place")
    count = ranked.agg(F.max("_place")).scalar()
    wanted = F.floor(F.lit(float(q)) * (count - F.lit(1))) + F.lit(1)
    return ranked.filter(F.col("_place") == wanted).agg(
        F.coalesce(F.max(value), F.lit(0.0)).alias("quantile")
    )
