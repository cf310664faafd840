"""Feature assembly and scoring of a pool as DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import TERMS, ScoreSettings, Settings
from plumbline.functions.scalar import fixed, is_target_title, location_score
from plumbline.functions.scoring import (
    availability_blend,
    availability_from_blend,
    availability_parts,
    base_fit,
    contributions,
    final_score,
    lexical_evidence,
    penalty_detail,
    penalty_sum,
    signal_features,
)
from plumbline.operators.membership import (
    restrict,
    with_signals,
    with_similarity,
)
from plumbline.operators.shortlist import is_contradictory, prefilter, with_impossible


def text_features(settings: Settings) -> dict[str, Column]:
    """Features and facts from profile, career_history and skills."""
    profile = F.col("profile")
    title = F.coalesce(F.nullif(profile["current_title"], F.lit("")), F.lit("(no title)"))
    return {
        "is_target": is_target_title(profile["current_title"], settings.filter.titles),
        "lexical_evidence": lexical_evidence(settings.score),
        "title": title,
        "years": profile["years_of_experience"],
        "country": profile["country"],
        "contradictory": is_contradictory(settings.integrity),
    }


def activity_features(settings: Settings) -> dict[str, Column]:
    """Features and facts from the activity block (and the country)."""
    activity, score = F.col("activity"), settings.score
    return {
        "blend": availability_blend(availability_parts(activity, score), score),
        "location": location_score(
            F.col("country"), activity["willing_to_relocate"], score.home_country,
            score.away_score,
        ),
        "notice_days": activity["notice_period_days"],
        "last_active": activity["last_active_date"],
        "is_open": activity["open_to_work_flag"],
        "relocates": activity["willing_to_relocate"],
    }


def narrow_records(pool: DataFrame, settings: Settings) -> DataFrame:
    """One short row per record. Done before any join or dedup, so texts never move."""
    keep = [n for n in ("id", "source_order", "activity") if n in pool.columns]
    texts = pool.select(*keep, *[c.alias(n) for n, c in text_features(settings).items()])
    return with_activity_features(texts, settings)


def with_activity_features(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.withColumns(activity_features(settings)).drop("activity")


def assemble_features(joined: DataFrame, settings: ScoreSettings) -> DataFrame:
    """Feature columns from (cosine, signal, blend, location, lexical_evidence, ...)."""
    features = signal_features(F.col("cosine"), F.col("signal"), settings)
    return joined.withColumns(
        {
            **features,
            "availability": availability_from_blend(
                F.col("blend"), settings.availability_floor
            ),
        }
    )


def with_score(features: DataFrame, settings: ScoreSettings) -> DataFrame:
    """base_fit, penalties, final and their breakdown."""
    parts = contributions(settings.weights)
    scored = features.withColumns(
        {
            "contributions": F.struct(*[parts[t].alias(t) for t in TERMS]),
            "base_fit": base_fit(parts),
            "penalties": penalty_sum(F.col("flags"), settings),
            "penalty_detail": penalty_detail(F.col("flags"), settings),
        }
    )
    final = final_score(
        F.col("base_fit"), F.col("penalties"), F.col("availability"), F.col("location"),
        F.col("impossible"),
    )
    return scored.withColumn("final", final)


def score_survivors(
    records: DataFrame,
    similarity: DataFrame,
    signals: DataFrame,
    settings: Settings,
    source_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Rank path: dedup, pre-filter, then features and score of the survivors only.

    ``records`` are narrow and say themselves whether they are ``contradictory``, so texts are
    read once. The filter needs titles and similarities alone, so signals are joined to
    survivors. All joins are on ``id``, which keeps one partitioning throughout.
    """
    unique = with_impossible(records, source_order)
    survivors = prefilter(unique, similarity, settings.filter)
    return score_joined(survivors, signals, settings)


def score_ids(
    records: DataFrame,
    similarity: DataFrame,
    signals: DataFrame,
    ids: DataFrame,
    settings: Settings,
) -> DataFrame:
    """Evaluation path: score the (narrow) records of a given id set, without a filter."""
    chosen = with_similarity(with_impossible(restrict(records, ids)), similarity)
    return score_joined(chosen, signals, settings)


def score_joined(records: DataFrame, signals: DataFrame, settings: Settings) -> DataFrame:
    joined = with_signals(records, signals)
    scored = with_score(assemble_features(joined, settings.score), settings.score)
    text = fixed(F.col("final"))
    return scored.withColumn("score", text).withColumn("score_value", text.cast("double"))


def order_by(key: str = "formatted") -> list[Column]:
    """Score descending, id ascending; on the printed or on the raw score."""
    column = {"formatted": "score_value", "raw": "final"}[key]
    return [F.col(column).desc(), F.col("id").asc()]


def breakdown_json(scored: DataFrame) -> DataFrame:
    """(id, breakdown): the whole score record as JSON."""
    fields = ("final", "base_fit", "penalties", "availability", "location", "impossible",
              "contributions", "penalty_detail")
    return scored.select("id", F.to_json(F.struct(*fields)).alias("breakdown"))


def explain_terms(scored: DataFrame) -> DataFrame:
    """Long form (id, term, raw, contribution), one row per weighted term."""
    rows = [
        F.struct(
            F.lit(i).alias("term_order"), F.lit(t).alias("term"), F.col(t).alias("raw"),
            F.col("contributions")[t].alias("contribution"),
        )
        for i, t in enumerate(TERMS)
    ]
    return scored.select("id", F.inline(F.array(*rows)))
