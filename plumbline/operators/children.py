"""Integrity rules over child tables instead of nested arrays.

When the parts of a record are rows of their own, "any child breaks the rule" is an
aggregate. Children are reduced per key before they meet their parents (map-side
first), so a parent with any number of children costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.integrity import reason_codes


def child_bounds(
    children: DataFrame, key: str, months: Column, start: Column, bad_skill: Column
) -> DataFrame:
    """Per key: longest and shortest duration, earliest start, any unused top skill."""
    return children.groupBy(key).agg(
        F.max(months).alias("longest"),
        F.min(months).alias("shortest"),
        F.min(start).alias("earliest"),
        F.coalesce(F.bool_or(bad_skill), F.lit(False)).alias("unused_skill"),
    )


def child_reasons(
    parents: DataFrame, bounds: DataFrame, key: str, limit: Column, not_before: Column
) -> DataFrame:
    """Parents with the sorted codes of the rules their children break, if any.

    ``limit`` is the longest duration a parent allows (exclusive), ``not_before`` the
    earliest start it allows.
    """
    joined = parents.join(bounds, key)
    reasons = reason_codes(
        F.col("unused_skill"),
        F.coalesce((limit > 0) & (F.col("longest") >= limit), F.lit(False)),
        F.coalesce((F.col("shortest") < 0) | (F.col("earliest") < not_before), F.lit(False)),
    )
    flagged = joined.select(key, reasons.alias("reasons"))
    return flagged.filter(F.size("reasons") > 0)
