"""Column functions that check a text against the facts of its record, and write one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import (
    DEFAULT_ROLE_PHRASE,
    FLAG_PHRASES,
    GENERIC_WORDS,
    ROLE_PHRASES,
    TextSettings,
)
from plumbline.functions.scalar import general, rank_tone, squeeze, strip
from plumbline.functions.text import (
    number_words,
    numbers,
    readable_join,
    roles_of,
    sentence_count,
    sentences,
    truncate_words,
    words,
)


def closed_world(profile: Column, career: Column, evidence: Column) -> Column:
    """All free text a record may be described with, skills excluded."""
    own = [profile[name] for name in (
        "current_title", "current_company", "summary", "headline", "location", "country")]
    per_role = F.flatten(
        F.transform(
            roles_of(career), lambda r: F.array(r["company"], r["title"], r["description"])
        )
    )
    parts = F.concat(F.array(*own), per_role, F.array(evidence))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def known_terms(corpus: Column) -> Column:
    return F.array_distinct(words(F.lower(corpus)))


def known_numbers(corpus: Column, years: Column, notice: Column, career: Column) -> Column:
    """Numbers of the text plus the record's years, notice period and role durations."""
    from_years = F.when(
        years.isNotNull(),
        F.array(years, F.floor(years).cast("double"), F.bround(years), F.ceil(years).cast(
            "double")),
    )
    months = F.filter(
        F.transform(roles_of(career), lambda r: r["duration_months"].cast("double")),
        lambda m: m.isNotNull(),
    )
    in_years = F.transform(months, lambda m: F.bround(m / F.lit(12.0)))
    none = F.array().cast("array<double>")
    return F.array_distinct(
        F.concat(
            numbers(corpus),
            F.coalesce(from_years, none),
            F.coalesce(F.when(notice.isNotNull(), F.array(notice.cast("double"))), none),
            months,
            in_years,
        )
    )


def leading_terms(parts: Mapping[str, Column], count: int) -> Column:
    """Names of the largest contributions; ties keep term order, zeros drop out last."""
    entries = F.array(*[
        F.struct((-value).alias("negated"), F.lit(i).alias("place"), F.lit(name).alias("name"))
        for i, (name, value) in enumerate(parts.items())
    ])
    largest = F.slice(F.sort_array(entries), 1, count)
    positive = F.filter(largest, lambda e: e["negated"] < 0)
    return F.transform(positive, lambda e: e["name"])


def flag_phrase(flag: Column) -> Column:
    pairs = [F.lit(part) for item in FLAG_PHRASES.items() for part in item]
    spoken = F.replace(flag, F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), flag), spoken)


def gap_notes(
    flags: Column, notice: Column, availability: Column, is_open: Column, settings: TextSettings
) -> Column:
    """What an honest text should not hide, as readable phrases in a fixed order."""
    observed = F.array(
        F.when(
            notice >= settings.long_notice_days,
            F.concat(notice.cast("string"), F.lit("-day notice period")),
        ),
        F.when(
            availability < settings.low_availability, "limited recent activity / engagement"
        ),
        F.when(~is_open, "not currently flagged open to work"),
    )
    return F.concat(F.transform(flags, flag_phrase), F.array_compact(observed))


def is_named(word: Column, place: Column) -> Column:
    """Reads as a specific name: acronym, inner capital, or capitalised inside a sentence."""
    acronym = word.rlike("^[A-Z][A-Z0-9]*$")
    inner_capital = word.rlike("^.+[A-Z]")
    capitalised = word.rlike("^[A-Z][a-z0-9]*[a-z][a-z0-9]*$")
    return (F.length(word) >= 2) & (
        acronym | inner_capital | (capitalised & (place > 0))
    )


def named_terms(text: Column) -> Column:
    """Distinct named words of a text, as they are written."""
    per_sentence = F.transform(sentences(text), lambda s: F.filter(words(s), is_named))
    return F.array_distinct(F.flatten(per_sentence))


def ungrounded_terms(text: Column, terms: Column) -> Column:
    """Named words that are neither generic nor in the record, sorted."""
    named = named_terms(text)
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    unknown = F.array_except(
        F.array_except(F.transform(named, lambda w: F.lower(w)), generic), terms
    )
    return F.sort_array(F.filter(named, lambda w: F.array_contains(unknown, F.lower(w))))


def ungrounded_numbers(text: Column, allowed: Column, settings: TextSettings) -> Column:
    """Numbers further than the tolerance from every allowed number, sorted as text."""
    tolerance = F.lit(settings.number_tolerance)
    found = F.array_distinct(number_words(text))
    bad = F.filter(
        found,
        lambda n: ~F.exists(allowed, lambda a: F.abs(n.cast("double") - a) < tolerance),
    )
    return F.sort_array(bad)


def text_issues(
    text: Column, terms: Column, allowed: Column, settings: TextSettings
) -> Column:
    """Everything wrong with a text; an empty array is a pass."""
    cleaned = strip(text)
    size = F.length(cleaned)
    unknown = ungrounded_terms(cleaned, terms)
    wrong = ungrounded_numbers(cleaned, allowed, settings)
    counted = F.concat(F.lit(" ("), size.cast("string"), F.lit(" chars)"))
    issues = F.array(
        F.when(size < settings.min_chars, F.concat(F.lit("too short"), counted)),
        F.when(size > settings.max_chars, F.concat(F.lit("too long"), counted)),
        F.when(
            sentence_count(cleaned) > settings.max_sentences,
            f"too many sentences (>{settings.max_sentences})",
        ),
        F.when(
            F.size(unknown) > 0,
            F.concat(F.lit("ungrounded terms: "), F.array_join(unknown, ", ")),
        ),
        F.when(
            F.size(wrong) > 0,
            F.concat(F.lit("ungrounded numbers: "), F.array_join(wrong, ", ")),
        ),
    )
    return F.when(cleaned == "", F.array(F.lit("empty reasoning"))).otherwise(
        F.array_compact(issues)
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def fallback_text(
    rank: Column, title: Column, years: Column, role: Column, built: Column, gaps: Column
) -> Column:
    """A text made of the record's own facts only, with its gaps named."""
    pairs = [F.lit(part) for item in ROLE_PHRASES.items() for part in item]
    phrase = F.coalesce(
        F.try_element_at(F.create_map(*pairs), role), F.lit(DEFAULT_ROLE_PHRASE)
    )
    tenure = F.coalesce(
        F.concat(general(years), F.lit(" years' experience")), F.lit("relevant experience")
    )
    lead = F.concat(
        capitalize(rank_tone(rank)), F.lit(" for the retrieval / ranking role: "), title,
        F.lit(" with "), tenure, F.lit(", "), phrase,
        F.when(built, ", having shipped a ranking or search system").otherwise(""), F.lit("."),
    )
    noted = F.concat(F.lit(" Noted gap: "), readable_join(gaps), F.lit("."))
    return F.concat(lead, F.when(F.size(gaps) > 0, noted).otherwise(""))


def fact_card(row: Mapping[str, Column], settings: TextSettings) -> Column:
    """One prompt entry: what a text about this record may use and must disclose."""

    def shown(value: Column, missing: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", missing).otherwise(value)

    years = F.coalesce(
        F.concat(general(row["years"]), F.lit(" yrs experience")), F.lit("experience n/a")
    )
    listed = F.array_join(row["gaps"], "; ")
    evidence = shown(truncate_words(row["evidence"], settings.prompt_evidence_chars),
                     "(none provided)")
    return F.concat(
        F.lit("["), row["rank"].cast("string"), F.lit("] id: "), row["id"],
        F.lit("\nrole: "), row["title"], F.lit("; "), years,
        F.lit("; country: "), shown(row["country"], "n/a"),
        F.lit("\nsignal: "), shown(row["role"], "n/a"), F.lit(" / "), shown(row["domain"], "n/a"),
        F.lit("; built: "), F.when(row["built"], "yes").otherwise("no"),
        F.lit("\nscore: "), F.call_function("format_number", row["final"], F.lit("0.00")),
        F.lit(" ("), rank_tone(row["rank"]), F.lit("); terms: "),
        shown(F.array_join(row["leading"], ", "), "n/a"),
        F.lit("\nevidence: "), evidence,
        F.lit("\ngaps: "), shown(listed, "none"),
    )


def clean_title(title: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.lit("(no title)"))


def final_text(text: Column) -> Column:
    return squeeze(text)
