"""Contradictions inside one record, as Column predicates over its nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import IntegritySettings
from plumbline.functions.scalar import iso_date, strip, years_to_months
from plumbline.functions.text import roles_of

# Reason codes.
EXPERT_ZERO = "expert_zero_duration"
ROLE_EXCEEDS = "role_exceeds_experience"
TIMELINE = "impossible_timeline"


def _any(array: Column, test) -> Column:
    """exists() that is false, not null, for null arrays and null comparisons."""
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def expert_without_use(skills: Column, settings: IntegritySettings) -> Column:
    return _any(
        skills,
        lambda s: (F.lower(strip(s["proficiency"])) == settings.top_proficiency)
        & (s["duration_months"] == 0),
    )


def role_longer_than_career(
    career: Column, years: Column, settings: IntegritySettings
) -> Column:
    """One role outlasts all claimed experience; skipped without positive experience."""
    months = years_to_months(years)
    limit = months + F.lit(settings.role_margin_months)
    too_long = _any(roles_of(career), lambda r: r["duration_months"] >= limit)
    return F.coalesce(months > 0, F.lit(False)) & too_long


def impossible_timeline(career: Column) -> Column:
    return _any(
        roles_of(career),
        lambda r: F.coalesce(r["duration_months"] < 0, F.lit(False))
        | F.coalesce(iso_date(r["end_date"]) < iso_date(r["start_date"]), F.lit(False)),
    )


def reason_codes(expert_zero: Column, role_exceeds: Column, timeline: Column) -> Column:
    """Sorted codes of the rules that fired, empty for a clean record."""
    fired = F.array(
        F.when(role_exceeds, ROLE_EXCEEDS),
        F.when(expert_zero, EXPERT_ZERO),
        F.when(timeline, TIMELINE),
    )
    return F.sort_array(F.array_compact(fired))


def integrity_reasons(
    skills: Column, career: Column, years: Column, settings: IntegritySettings
) -> Column:
    return reason_codes(
        expert_without_use(skills, settings),
        role_longer_than_career(career, years, settings),
        impossible_timeline(career),
    )
