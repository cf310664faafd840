"""Explicit schemas (DDL). Every field is nullable: an absent value is handled where it is used."""

from __future__ import annotations

PROFILE = (
    "struct<anonymized_name: string, headline: string, summary: string, location: string, "
    "country: string, years_of_experience: double, current_title: string, "
    "current_company: string, current_company_size: string, current_industry: string>"
)
ROLE = (
    "struct<company: string, title: string, start_date: string, end_date: string, "
    "duration_months: int, is_current: boolean, industry: string, company_size: string, "
    "description: string>"
)
SKILL = "struct<name: string, proficiency: string, endorsements: int, duration_months: int>"
EDUCATION = (
    "struct<institution: string, degree: string, field_of_study: string, start_year: int, "
    "end_year: int, grade: string, tier: string>"
)
CERTIFICATION = "struct<name: string, issuer: string, year: int>"
LANGUAGE = "struct<language: string, proficiency: string>"
ACTIVITY = (
    "struct<profile_completeness_score: double, signup_date: string, last_active_date: string, "
    "open_to_work_flag: boolean, profile_views_received_30d: int, "
    "applications_submitted_30d: int, recruiter_response_rate: double, "
    "avg_response_time_hours: double, skill_assessment_scores: map<string,double>, "
    "connection_count: int, endorsements_received: int, notice_period_days: int, "
    "expected_salary_range: struct<min: double, max: double>, preferred_work_mode: string, "
    "willing_to_relocate: boolean, github_activity_score: double, search_appearance_30d: int, "
    "saved_by_recruiters_30d: int, interview_completion_rate: double, "
    "offer_acceptance_rate: double, verified_email: boolean, verified_phone: boolean, "
    "linkedin_connected: boolean>"
)


def record_fields(id_field: str = "id", activity_field: str = "activity") -> dict[str, str]:
    """Name and type of the fields of one JSON record; two names differ between owners."""
    return {
        id_field: "string",
        "profile": PROFILE,
        "career_history": f"array<{ROLE}>",
        "education": f"array<{EDUCATION}>",
        "skills": f"array<{SKILL}>",
        "certifications": f"array<{CERTIFICATION}>",
        "languages": f"array<{LANGUAGE}>",
        activity_field: ACTIVITY,
    }


def record_schema(id_field: str = "id", activity_field: str = "activity") -> str:
    fields = record_fields(id_field, activity_field)
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


SIGNALS = (
    "id string, role_archetype string, domain string, product_vs_services double, "
    "seniority_band_fit double, built_ranking_or_search boolean, evidence_span string, "
    "disqualifier_flags array<string>"
)
RUBRIC_LISTS = ("role_archetypes", "must_haves", "nice_to_haves", "hard_disqualifiers", "domains")
