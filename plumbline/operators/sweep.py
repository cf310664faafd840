"""Parameter sweeps: every configuration is scored, ranked and judged in one job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import TERMS, MetricSettings, ScoreSettings, ordered_sum
from plumbline.functions.scoring import (
    availability_from_blend,
    base_fit,
    contributions,
    final_score,
)
from plumbline.operators.metrics import HEAD, quality
from plumbline.operators.ordering import positions, top_per_group

# The grids of the four views.
FLOORS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
COORDINATE_STEPS = (-0.08, -0.04, 0.0, 0.04, 0.08)
STABILITY_STEPS = (-0.20, -0.10, 0.10, 0.20)
LOCKED_FLOOR = 0.70


@dataclass(frozen=True)
class Config:
    """One grid row: the seven weights and the availability floor."""

    family: str
    label: str
    weights: Mapping[str, float]
    floor: float


def renormalize(weights: Mapping[str, float]) -> dict[str, float]:
    total = ordered_sum(weights[t] for t in TERMS)
    if total <= 0:
        raise ValueError("the weights must add up to a positive number")
    return {t: weights[t] / total for t in TERMS}


def set_weight(weights: Mapping[str, float], term: str, value: float) -> dict[str, float]:
    """All weights with ``term`` at ``value`` (one at most) of a sum of one.

    The others divide the remainder in proportion, or evenly where they are all zero.
    """
    target = value / max(value, 1.0)
    held = ordered_sum(weights[t] for t in TERMS if t != term)
    portions = {t: weights[t] / held if held > 0 else 1 / (len(TERMS) - 1) for t in TERMS}
    return {t: target if t == term else (1 - target) * portions[t] for t in TERMS}


def floor_grid(base: ScoreSettings) -> list[Config]:
    return [Config("floor", f"{f:.2f}", dict(base.weights), f) for f in FLOORS]


def _weight_grid(
    family: str, base: ScoreSettings, points: Iterable[tuple[str, float, str]]
) -> list[Config]:
    """A configuration for every (term, value, label)."""
    return [
        Config(family, label, set_weight(base.weights, term, value), base.availability_floor)
        for term, value, label in points
    ]


def coordinate_grid(base: ScoreSettings) -> list[Config]:
    steps = {
        (term, round(max(0.0, base.weights[term] + step), 3))
        for term, step in product(TERMS, COORDINATE_STEPS)
    }
    ordered = sorted(steps, key=lambda point: (TERMS.index(point[0]), point[1]))
    return _weight_grid("weight", base, ((t, v, f"{t}={v:.3f}") for t, v in ordered))


def stability_grid(base: ScoreSettings) -> list[Config]:
    scaled = (
        (term, base.weights[term] * (1 + step), f"{term}{step:+.0%}")
        for term, step in product(TERMS, STABILITY_STEPS)
    )
    floors = [
        Config("stability", f"floor{step:+.0%}", dict(base.weights),
               base.availability_floor * (1 + step))
        for step in STABILITY_STEPS
    ]
    return _weight_grid("stability", base, scaled) + floors


def ablation_grid(base: ScoreSettings) -> list[Config]:
    return [
        Config("ablation", f"-{t}", set_weight(base.weights, t, 0.0), base.availability_floor)
        for t in TERMS
    ]


def baseline(base: ScoreSettings) -> Config:
    return Config("baseline", "baseline", dict(base.weights), base.availability_floor)


def locked(base: ScoreSettings) -> Config:
    return Config("locked", "locked", dict(base.weights), LOCKED_FLOOR)


def full_grid(base: ScoreSettings) -> list[Config]:
    fixed_floor = base.with_floor(LOCKED_FLOOR)
    return [
        baseline(base),
        *floor_grid(base),
        *coordinate_grid(base),
        *stability_grid(fixed_floor),
        *ablation_grid(fixed_floor),
        locked(base),
    ]


def _grid_rows(grid: Sequence[Config]) -> Column:
    rows = [
        F.struct(
            F.lit(i).alias("config_id"),
            *[F.lit(float(c.weights[t])).alias(f"w_{t}") for t in TERMS],
            F.lit(float(c.floor)).alias("floor"),
        )
        for i, c in enumerate(grid)
    ]
    return F.array(*rows)


def config_table(spark, grid: Sequence[Config]) -> DataFrame:
    """The grid as a table (tens of rows)."""
    rows = [
        (i, c.family, c.label, *[float(c.weights[t]) for t in TERMS], float(c.floor))
        for i, c in enumerate(grid)
    ]
    weights = ", ".join(f"w_{t} double" for t in TERMS)
    return spark.createDataFrame(
        rows, f"config_id int, family string, label string, {weights}, floor double"
    )


def rescore(features: DataFrame, grid: Sequence[Config]) -> DataFrame:
    """(config_id, id, final, ...) for every record and configuration.

    ``features`` holds the terms, blend, location, penalties and impossible; only
    weights and floor vary, so a record is expanded by the grid where it is.
    """
    keep = [n for n in ("tier", "has_flags") if n in features.columns]
    wide = features.select(
        "id", *TERMS, "blend", "location", "penalties", "impossible", *keep,
        F.explode(_grid_rows(grid)).alias("_config"),
    )
    parts = contributions({t: F.col(f"_config.w_{t}") for t in TERMS})
    final = final_score(
        base_fit(parts), F.col("penalties"),
        availability_from_blend(F.col("blend"), F.col("_config.floor")),
        F.col("location"), F.col("impossible"),
    )
    return wide.select(
        F.col("_config.config_id").alias("config_id"), "id", "impossible", *keep,
        final.alias("final"),
    )


def _order() -> list[Column]:
    return [F.col("final").desc(), F.col("id").asc()]


def rank_configs(rescored: DataFrame) -> DataFrame:
    """Full ranking per configuration, without one task per configuration."""
    return positions(rescored, _order(), ["config_id"])


def headlines(rescored: DataFrame, settings: MetricSettings) -> DataFrame:
    """One row per configuration: metrics of the judged rows and the two top checks.

    ``rescored`` carries ``tier``, null for records without a label. Only judged rows are
    put in order; the checks look at the head of each configuration.
    """
    judged = positions(rescored.filter(F.col("tier").isNotNull()), _order(), ["config_id"])
    metrics = quality(judged, ["config_id"], settings)
    head = top_per_group(rescored, ["config_id"], _order(), max(HEAD, settings.trap_rank))
    checks = head.groupBy("config_id").agg(
        F.count_if(F.col("impossible") & (F.col("rank") <= 100)).alias("impossible_in_top_100"),
        F.count_if(
            (F.col("tier") <= settings.trap_tier) & (F.col("rank") <= settings.trap_rank)
        ).alias("traps_in_top_50"),
    )
    return metrics.join(checks, "config_id")


def with_delta(rows: DataFrame, base_id: int) -> DataFrame:
    """Composite of every configuration minus the composite of one of them."""
    base = rows.filter(F.col("config_id") == base_id).select("composite").scalar()
    return rows.withColumn("delta", F.col("composite") - base)


def worst_swing(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.abs(F.col("delta"))).alias("worst_swing"))


def buried(ranking: DataFrame, gold: DataFrame, settings: MetricSettings) -> DataFrame:
    """Strong gold ids that the baseline ranks too low or not at all."""
    strong = gold.filter(F.col("tier") >= settings.strong_tier)
    placed = strong.join(ranking.select("id", "rank"), "id", "left")
    return placed.filter(F.col("rank").isNull() | (F.col("rank") > settings.buried_rank))


def tracked_ranks(
    ranked: DataFrame, tracked: DataFrame, grid: Sequence[Config]
) -> DataFrame:
    """(config_id, id, rank) of the tracked ids; -1 where a configuration lost one.

    The grid is a fixed handful of rows, so pairing it with the ids is an expansion
    of the ids and not a join of two tables that grow.
    """
    ids = [F.lit(i) for i in range(len(grid))]
    wanted = tracked.select("id").distinct().select("id", F.explode(F.array(*ids)).alias(
        "config_id"))
    found = wanted.join(ranked.select("config_id", "id", "rank"), ["config_id", "id"], "left")
    return found.withColumn("rank", F.coalesce("rank", F.lit(-1).cast("bigint")))
