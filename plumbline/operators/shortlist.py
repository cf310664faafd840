"""Pre-filter, threshold scan and integrity flags over the pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import FilterSettings, IntegritySettings
from plumbline.functions.integrity import integrity_reasons
from plumbline.functions.scalar import filter_branch, is_target_title, passes_filter
from plumbline.operators.membership import with_similarity
from plumbline.operators.ordering import last_per_key

# Thresholds 0.500, 0.525, ... 0.850 of the scan.
SCAN_GRID: tuple[float, ...] = tuple(round(0.5 + 0.025 * i, 3) for i in range(15))


def mark_targets(pool: DataFrame, settings: FilterSettings) -> DataFrame:
    title = F.col("profile.current_title")
    return pool.withColumn("is_target", is_target_title(title, settings.titles))


def prefilter(pool: DataFrame, similarity: DataFrame, settings: FilterSettings) -> DataFrame:
    """Survivors with ``cosine``, ``is_target`` and the branch that kept them."""
    marked = pool if "is_target" in pool.columns else mark_targets(pool, settings)
    joined = with_similarity(marked, similarity)
    is_target, cosine = F.col("is_target"), F.col("cosine")
    return joined.filter(passes_filter(is_target, cosine, settings.threshold)).withColumn(
        "branch", filter_branch(is_target, cosine, settings.threshold)
    )


def threshold_scan(
    marked: DataFrame, grid: Sequence[float] = SCAN_GRID, value: str = "cosine"
) -> DataFrame:
    """Survivors per threshold in one pass over ``marked`` (is_target, value)."""
    is_target, cosine = F.col("is_target"), F.col(value)
    counts = [F.count_if(is_target).alias("targets")]
    for i, threshold in enumerate(grid):
        similar = cosine >= F.lit(float(threshold))
        counts += [
            F.count_if(similar).alias(f"similar_{i}"),
            F.count_if(is_target | similar).alias(f"union_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(float(threshold)).alias("threshold"),
            F.col(f"similar_{i}").alias("by_similarity"),
            F.col(f"union_{i}").alias("by_union"),
            (F.col(f"union_{i}") - F.col("targets")).alias("over_targets"),
        )
        for i, threshold in enumerate(grid)
    ]
    return marked.agg(*counts).select(F.inline(F.array(*rows)))


def is_contradictory(settings: IntegritySettings) -> Column:
    """Does any integrity rule fire on (skills, career_history, profile) of the row."""
    reasons = integrity_reasons(
        F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"), settings
    )
    return F.size(reasons) > 0


def with_impossible(
    records: DataFrame, source_order: Sequence[Column] | None = None
) -> DataFrame:
    """``impossible``: is any record of the id ``contradictory``.

    With ``source_order`` the first record of every id is kept and records without an id are
    dropped; both take the one exchange by id that the joins on ids use as well.
    """
    own = F.col("id").isNotNull() & F.col("contradictory")
    if source_order is None:
        any_of = F.max(own).over(Window.partitionBy("id"))
        return records.withColumn("impossible", any_of).drop("contradictory")
    keyed = records.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    ordered = Window.partitionBy("id").orderBy(*source_order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = keyed.withColumns(
        {"impossible": F.max(own).over(whole), "_first": F.row_number().over(ordered)}
    )
    return marked.filter("_first = 1").drop("_first", "contradictory")


def integrity_flags(pool: DataFrame, settings: IntegritySettings) -> DataFrame:
    """(id, reasons) of the contradictory records; records without an id are dropped.

    Of several contradictory records with one id the last one in source order counts.
    """
    reasons = integrity_reasons(
        F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"), settings
    )
    # The row stamp keeps the filter above the projection: pushed below, it would
    # evaluate all rules a second time.
    judged = pool.filter(F.col("id").isNotNull()).select(
        "id", reasons.alias("reasons"), "source_order",
        F.monotonically_increasing_id().alias("_row"),
    )
    found = judged.filter((F.size("reasons") > 0) & (F.col("_row") >= 0)).drop("_row")
    return last_per_key(found, "id", F.col("source_order")).drop("source_order")
