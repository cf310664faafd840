"""Column functions over free text and over arrays of roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalar import general, python_bool, squeeze, strip
from plumbline.schema import ROLE

WORD = r"([A-Za-z][A-Za-z0-9]*)"
NUMBER = r"(\d+(?:\.\d+)?)"
SENTENCE_END = r"[.!?]+"

# Label in the profile card, field of the activity block.
CARD_SIGNALS: tuple[tuple[str, str], ...] = (
    ("last_active", "last_active_date"),
    ("open_to_work", "open_to_work_flag"),
    ("recruiter_response_rate", "recruiter_response_rate"),
    ("interview_completion_rate", "interview_completion_rate"),
    ("notice_period_days", "notice_period_days"),
    ("willing_to_relocate", "willing_to_relocate"),
)
CARD_ROLES = 6
EXCERPT_ROLES = 3


def roles_of(career: Column) -> Column:
    """The role array, empty where the record has none."""
    return F.coalesce(career, F.array().cast(f"array<{ROLE}>"))


def joined_career(profile: Column, career: Column) -> Column:
    """Title, summary and role descriptions with their own white space."""
    return F.concat_ws(" ", profile["current_title"], profile["summary"], career["description"])


def career_text(profile: Column, career: Column, max_chars: int | None) -> Column:
    """Title, summary and role descriptions in order; skills never enter.

    Squeezing the joined text equals joining the squeezed, non-empty parts, and needs
    one pass over the text.
    """
    text = squeeze(joined_career(profile, career))
    return text if max_chars is None else F.trim(F.substring(text, 1, max_chars))


def _or_else(text: Column, fallback: str) -> Column:
    return F.when(text == "", fallback).otherwise(text)


def _prefixed(prefix: str, text: Column) -> Column:
    """The text behind its prefix, null (skipped by concat_ws) where it is empty."""
    return F.when(text != "", F.concat(F.lit(prefix), text))


def role_line(role: Column) -> Column:
    """``- title @ company (n mo): description`` with only the parts that exist."""
    months = F.concat(F.lit(" ("), role["duration_months"].cast("string"), F.lit(" mo)"))
    return F.concat(
        F.lit("- "),
        _or_else(squeeze(role["title"]), "(role)"),
        F.lit(" @ "),
        _or_else(squeeze(role["company"]), "(company)"),
        F.coalesce(months, F.lit("")),
        F.coalesce(_prefixed(": ", squeeze(role["description"])), F.lit("")),
    )


def signal_line(activity: Column) -> Column:
    """``k=v`` list of the activity fields that are present, in a fixed order."""
    shown = []
    for label, name in CARD_SIGNALS:
        value = activity[name]
        is_flag = name in ("open_to_work_flag", "willing_to_relocate")
        value = python_bool(value) if is_flag else value.cast("string")
        shown.append(F.concat(F.lit(label + "="), value))
    return F.concat_ws(", ", *shown)


def profile_card(profile: Column, career: Column, activity: Column) -> Column:
    """Labelled multi-line rendering of a record."""
    where = F.concat_ws(
        ", ",
        F.array_compact(
            F.array(
                _prefixed("", squeeze(profile["location"])),
                _prefixed("", squeeze(profile["country"])),
            )
        ),
    )
    years = F.concat(general(profile["years_of_experience"]), F.lit(" yrs experience"))
    header = F.concat_ws(
        " · ", _or_else(squeeze(profile["current_title"]), "(no title)"), years,
        F.when(where != "", where),
    )
    recent = F.slice(roles_of(career), 1, CARD_ROLES)
    lines = F.array_join(F.transform(recent, role_line), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Current role: "), header),
        _prefixed("Summary: ", squeeze(profile["summary"])),
        F.when(F.size(recent) > 0, F.concat(F.lit("Career history:\n"), lines)),
        _prefixed("Availability signals: ", signal_line(activity)),
    )


def clip_text(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when something was cut."""
    text = squeeze(text)
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def truncate_words(text: Column, limit: int) -> Column:
    """Cut at the last word boundary inside ``limit`` characters, then an ellipsis."""
    text = squeeze(text)
    head = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def career_excerpt(career: Column, max_roles: int = EXCERPT_ROLES) -> Column:
    def render(role: Column) -> Column:
        months = F.concat(F.lit(" ("), role["duration_months"].cast("string"), F.lit("mo)"))
        return F.concat(
            _or_else(strip(role["title"]), "(role)"),
            F.lit(" @ "),
            _or_else(strip(role["company"]), "(company)"),
            F.coalesce(months, F.lit("")),
            F.coalesce(_prefixed(": ", clip_text(role["description"], 120)), F.lit("")),
        )

    return F.array_join(F.transform(F.slice(roles_of(career), 1, max_roles), render), " | ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def number_words(text: Column) -> Column:
    """The numbers of a text as they are written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def numbers(text: Column) -> Column:
    return F.transform(number_words(text), lambda word: word.cast("double"))


def sentences(text: Column) -> Column:
    """Pieces between runs of end marks; a decimal point ends a piece, too."""
    return F.split(text, SENTENCE_END, -1)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(sentences(text), lambda piece: squeeze(piece) != ""))


def fingerprint(text: Column) -> Column:
    """Letters only, numbers as '#', single spaces: the skeleton of a text."""
    skeleton = F.regexp_replace(F.lower(text), NUMBER, "#")
    return F.trim(F.regexp_replace(skeleton, "[^a-z#]+", " "))


def fingerprint_words(text: Column) -> Column:
    """Distinct words of the fingerprint; an empty array for a text without any."""
    return F.array_remove(F.array_distinct(F.split(fingerprint(text), " ")), "")


def readable_join(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    size = F.size(items)
    listed = F.array_join(F.slice(items, 1, F.greatest(size - 1, F.lit(0))), ", ")
    return (
        F.when(size == 0, "")
        .when(size == 1, F.get(items, F.lit(0)))
        .otherwise(F.concat(listed, F.lit(" and "), F.get(items, size - 1)))
    )


def contains_any(text: Column, cues: Sequence[str]) -> Column:
    """Substring test against every cue, on lower-cased text."""
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def mentions_gap(text: Column, cues: Sequence[str]) -> Column:
    return F.coalesce(contains_any(F.lower(text), cues), F.lit(False))


def keyword_evidence(text: Column, categories: Mapping[str, Sequence[str]]) -> Column:
    """Share of keyword categories with at least one substring hit."""
    if not categories:
        return F.lit(0.0)
    lowered = F.lower(text)
    hits = F.lit(0)
    for terms in categories.values():
        hits = hits + contains_any(lowered, terms).cast("int")
    return hits / F.lit(float(len(categories)))


def prefixed(prefix: str, text: Column) -> Column:
    """Encoder input: the instruction of one side, then the text."""
    return F.concat(F.lit(prefix), text)
