"""From a joined record to features, and from features to the final score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import NEUTRAL, TERMS, ScoreSettings, ordered_sum
from plumbline.functions.scalar import (
    clip01,
    flag_score,
    lookup,
    notice_score,
    recency_score,
    rescale,
    sentinel_rate,
    unit_rate,
)
from plumbline.functions.text import career_text, joined_career, keyword_evidence


def availability_parts(activity: Column, settings: ScoreSettings) -> dict[str, Column]:
    """The behaviour components by name, each in [0, 1], neutral where unknown."""
    return {
        "recency": recency_score(
            activity["last_active_date"], settings.snapshot_date, settings.recency_days
        ),
        "recruiter_response_rate": unit_rate(activity["recruiter_response_rate"]),
        "open_to_work": flag_score(activity["open_to_work_flag"], 1.0, settings.not_open_score),
        "interview_completion_rate": unit_rate(activity["interview_completion_rate"]),
        "notice_period": notice_score(activity["notice_period_days"], settings.notice_days),
        "offer_acceptance": sentinel_rate(activity["offer_acceptance_rate"]),
        "verified_email": flag_score(activity["verified_email"], 1.0, 0.0),
        "verified_phone": flag_score(activity["verified_phone"], 1.0, 0.0),
    }


def _plus(columns) -> Column:
    """Left-to-right addition, so that every engine rounds alike."""
    total = F.lit(0.0)
    for column in columns:
        total = total + column
    return total


def availability_blend(parts: Mapping[str, Column], settings: ScoreSettings) -> Column:
    weights = settings.availability_weights
    total = ordered_sum(weights.values())
    if total <= 0:
        return F.lit(0.0)
    return _plus(F.lit(weights.get(name, 0.0)) * part for name, part in parts.items()) / F.lit(
        total
    )


def availability_from_blend(blend: Column, floor: Column | float) -> Column:
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    return floor + (F.lit(1.0) - floor) * blend


def lexical_evidence(settings: ScoreSettings) -> Column:
    """Keyword evidence in the career text (columns profile, career_history).

    White space matters to phrases and to a limit of characters only; without both the text is
    searched as it is, which saves a pass over it.
    """
    profile, career = F.col("profile"), F.col("career_history")
    terms = [term for category in settings.keywords.values() for term in category]
    if settings.text_chars is None and all(term.split() == [term] for term in terms):
        return keyword_evidence(joined_career(profile, career), settings.keywords)
    return keyword_evidence(career_text(profile, career, settings.text_chars), settings.keywords)


def signal_features(cosine: Column, signal: Column, settings: ScoreSettings) -> dict[str, Column]:
    """Features from similarity and signals; without signals similarity stands in."""
    career_sim = rescale(cosine, settings.cosine_floor, settings.cosine_ceiling)
    known = signal.isNotNull()
    role = lookup(signal["role_archetype"], settings.role_scores, settings.default_role_score)
    domain = lookup(signal["domain"], settings.domain_scores, settings.default_domain_score)
    built = F.coalesce(signal["built_ranking_or_search"], F.lit(False))
    no_flags = F.array().cast("array<string>")
    return {
        "career_sim": career_sim,
        "role_match": F.when(known, role).otherwise(career_sim),
        "domain_match": F.when(known, domain).otherwise(career_sim),
        "product_ratio": F.when(known, clip01(signal["product_vs_services"])).otherwise(NEUTRAL),
        "seniority_fit": F.when(known, clip01(signal["seniority_band_fit"])).otherwise(NEUTRAL),
        "built_ranking": F.when(known & built, 1.0).otherwise(0.0),
        "flags": F.coalesce(signal["disqualifier_flags"], no_flags),
    }


def contributions(weights: Mapping[str, Column | float]) -> dict[str, Column]:
    """Weighted terms over feature columns of the same names."""
    return {
        term: (w if isinstance(w, Column) else F.lit(float(w))) * F.col(term)
        for term, w in ((t, weights[t]) for t in TERMS)
    }


def base_fit(parts: Mapping[str, Column]) -> Column:
    return _plus(parts.values())


def penalty_points(flags: Column, settings: ScoreSettings) -> Column:
    """Points per distinct flag, in flag order; unknown flags cost nothing."""
    return F.transform(
        F.array_distinct(flags), lambda flag: lookup(flag, settings.penalties, 0.0)
    )


def penalty_detail(flags: Column, settings: ScoreSettings) -> Column:
    return F.map_from_arrays(F.array_distinct(flags), penalty_points(flags, settings))


def penalty_sum(flags: Column, settings: ScoreSettings) -> Column:
    return F.aggregate(
        penalty_points(flags, settings), F.lit(0.0), lambda total, points: total + points
    )


def final_score(
    fit: Column, penalties: Column, availability: Column, location: Column, impossible: Column
) -> Column:
    """Penalties bite first, then the multipliers; a contradictory record gets zero."""
    net = F.greatest(F.lit(0.0), fit - penalties)
    return F.when(impossible, 0.0).otherwise(net * availability * location)
