"""Integrity rules (H*), over nested arrays of the pool and over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import joined, query
from plumbline.functions import integrity as ig
from plumbline.operators.children import child_bounds, child_reasons


@query(
    "h1_expert_without_use",
    S.using(
        """SELECT id, lower(trim(proficiency)) = 'expert' AND skill_months = 0 AS fired
        FROM docs""",
        "docs",
    ),
)
def expert(data):
    rule = ig.expert_without_use(F.col("skills"), data.settings.integrity)
    return data.texts_pool.select("id", rule.alias("fired"))


@query(
    "h2_role_longer_than_career",
    S.using(
        f"""SELECT id, years > 0 AND len(list_filter(career, lambda r: r.months >=
        years * 12.0::DOUBLE + {S.MARGIN})) > 0 AS fired FROM docs""",
        "docs",
    ),
)
def too_long(data):
    years = F.col("profile.years_of_experience")
    rule = ig.role_longer_than_career(F.col("career_history"), years, data.settings.integrity)
    return data.texts_pool.select("id", rule.alias("fired"))


@query(
    "h3_impossible_timeline",
    S.using(
        """SELECT id, len(list_filter(career, lambda r: r.months < 0 OR
        coalesce(r.stop < r.start, false))) > 0 AS fired FROM docs""",
        "docs",
    ),
)
def timeline(data):
    return data.texts_pool.select(
        "id", ig.impossible_timeline(F.col("career_history")).alias("fired")
    )


@query(
    "h4_reason_codes",
    S.using(
        """SELECT docs.id, coalesce(array_to_string(reasons, '|'), '') AS reasons FROM docs
        LEFT JOIN flagged ON docs.id = flagged.id""",
        "docs", "flagged",
    ),
)
def reasons(data):
    codes = ig.integrity_reasons(
        F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience"),
        data.settings.integrity,
    )
    return data.texts_pool.select("id", joined(codes).alias("reasons"))


@query(
    "h5_flagged",
    S.using("SELECT id, array_to_string(reasons, '|') AS reasons FROM flagged", "flagged"),
)
def flagged(data):
    return data.flagged.select("id", joined("reasons").alias("reasons"))


@query(
    "h5_flagged_orders",
    """WITH b AS (SELECT l_orderkey, max(l_quantity) AS longest, min(l_quantity) AS shortest,
        min(l_shipdate) AS earliest, bool_or(l_returnflag = 'R' AND l_discount = 0) AS unused
      FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT o_orderkey, list_filter([
        CASE WHEN unused THEN 'expert_zero_duration' END,
        CASE WHEN earliest < o_orderdate - INTERVAL 1500 DAY THEN 'impossible_timeline' END,
        CASE WHEN longest >= o_totalprice / 10000.0::DOUBLE + 12
          THEN 'role_exceeds_experience' END], lambda x: x IS NOT NULL) AS reasons
      FROM orders JOIN b ON o_orderkey = l_orderkey)
    SELECT o_orderkey, array_to_string(reasons, '|') AS reasons FROM r WHERE len(reasons) > 0""",
)
def flagged_orders(data):
    lines = data.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    unused = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)
    bounds = child_bounds(
        lines, "o_orderkey", F.col("l_quantity"), F.col("l_shipdate"), unused
    )
    orders = data.table("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    margin = F.lit(data.settings.integrity.role_margin_months)
    limit = F.col("o_totalprice") / F.lit(10000.0) + margin
    not_before = F.col("o_orderdate") - F.expr("INTERVAL 1500 DAYS")
    rows = child_reasons(orders, bounds, "o_orderkey", limit, not_before)
    return rows.select("o_orderkey", joined("reasons").alias("reasons"))
