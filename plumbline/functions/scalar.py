"""Column functions over single values: cleaning, bounding, scoring, formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import LAST_TONE, NEUTRAL, TONES

# Java's \s is ASCII only; this class also covers the Unicode separators and the
# control characters that count as white space when text is split into words.
WHITESPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def squeeze(text: Column) -> Column:
    """One space between words, none at the ends; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(text.cast("string"), WHITESPACE, " ")), F.lit(""))


def strip(text: Column) -> Column:
    """White space removed from both ends only; null becomes ''."""
    ends = f"^{WHITESPACE}|{WHITESPACE}$"
    return F.coalesce(F.regexp_replace(text, ends, ""), F.lit(""))


def normalize_title(title: Column) -> Column:
    return F.lower(squeeze(title))


def is_target_title(title: Column, titles: Sequence[str]) -> Column:
    return normalize_title(title).isin(*titles)


def passes_filter(is_target: Column, similarity: Column, threshold: float) -> Column:
    return is_target | (similarity >= F.lit(float(threshold)))


def filter_branch(is_target: Column, similarity: Column, threshold: float) -> Column:
    """Which side of the OR kept a survivor."""
    similar = similarity >= F.lit(float(threshold))
    return (
        F.when(is_target & similar, "both").when(is_target, "archetype").otherwise("similarity")
    )


def clip01(value: Column) -> Column:
    """Clamp to [0, 1]; null stays null (greatest and least would skip it)."""
    number = value.cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def rescale(value: Column, low: float, high: float) -> Column:
    """Stretch [low, high] to [0, 1] and clamp; an empty window only clamps."""
    span = high - low
    if span <= 0:
        return clip01(value)
    return clip01((value - F.lit(float(low))) / F.lit(span))


def unit_rate(value: Column) -> Column:
    return F.when(value.isNull(), NEUTRAL).otherwise(clip01(value))


def sentinel_rate(value: Column) -> Column:
    """A negative rate means "no history", which is neutral and not the worst."""
    return F.when(value.isNull() | (value < 0), NEUTRAL).otherwise(clip01(value))


def flag_score(value: Column, when_true: float, when_false: float) -> Column:
    return F.when(value, when_true).when(~value, when_false).otherwise(NEUTRAL)


def notice_score(days: Column, longest: int) -> Column:
    return F.when(days.isNull(), NEUTRAL).otherwise(
        clip01(F.lit(1.0) - days.cast("double") / F.lit(longest))
    )


def iso_date(text: Column) -> Column:
    """Date in the first ten characters, null for anything else (never an error)."""
    head = F.substring(text, 1, 10)
    return (
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.call_function(
            "try_to_date", head, F.lit("yyyy-MM-dd")))
        .when(head.rlike(r"^\d{8}$"), F.call_function("try_to_date", head, F.lit("yyyyMMdd")))
    )


def recency_score(date_text: Column, snapshot: str, horizon_days: int) -> Column:
    """Linear decay before a fixed snapshot date; never the current date."""
    days = F.datediff(F.lit(snapshot).cast("date"), iso_date(date_text))
    return (
        F.when(days.isNull(), NEUTRAL)
        .when(days <= 0, 1.0)
        .otherwise(clip01(F.lit(1.0) - days / F.lit(horizon_days)))
    )


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Score of a vocabulary word, the default for words outside the vocabulary."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    if not pairs:
        return F.lit(float(default))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(float(default)))


def location_score(country: Column, relocates: Column, home: str, away: float) -> Column:
    at_home = F.lower(strip(country)) == F.lit(home)
    return F.when(at_home | F.coalesce(relocates, F.lit(False)), 1.0).otherwise(float(away))


def years_to_months(years: Column) -> Column:
    return years.cast("double") * F.lit(12.0)


def fixed(value: Column, decimals: int = 6) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value.

    ``format_number`` with a pattern is the only built-in that rounds this way;
    ``round`` and ``format_string`` differ on about one value in seven. For scores and the
    like; numbers that can reach PRINTED go through :func:`fixed_any`.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


# From here on a double has fewer decimals than six, or more digits than Java prints.
PRINTED = 2.0**33
# From here on a bigint doesn't hold it.
WHOLE = 2.0**63
_LIMB, _LIMBS, _BITS = 15, 21, 9


def fixed_any(value: Column, decimals: int = 6) -> Column:
    """As :func:`fixed`, for numbers of any size, as texts hold them; up to six decimals.

    ``format_number`` prints the shortest digits that tell a double apart, and zeros behind
    them: right below PRINTED only.
    """
    value = value.cast("double")
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    point = "." + "0" * decimals if decimals else ""
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size >= WHOLE, F.concat(sign, _whole_digits(size), F.lit(point)))
        .when(size >= PRINTED, F.concat(sign, _split_digits(size, decimals)))
        .otherwise(fixed(value, decimals))
    )


def _split_digits(value: Column, decimals: int) -> Column:
    """Digits from PRINTED on, below WHOLE: at most 19 bits are decimals, so all steps are exact."""
    if not decimals:
        return F.rint(value).try_cast("bigint").cast("string")
    scale = 10**decimals
    whole = F.floor(value)
    rest = F.rint((value - whole.cast("double")) * F.lit(float(scale))).try_cast("bigint")
    carried = F.when(rest == scale, whole + 1).otherwise(whole).cast("string")
    shown = F.lpad((rest % F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(carried, F.lit("."), shown)


def _whole_digits(value: Column) -> Column:
    """Digits of a finite double from WHOLE on: its 53 bits, shifted up in limbs of 15 digits.

    A limb shifted by _BITS is a multiple of 2**_BITS, and so is a limb's range; the carry from
    the limb below is smaller, so one addition never carries on.
    """
    base, shift = F.lit(10**_LIMB), F.lit(1 << _BITS)
    times = F.floor((F.floor(F.log2(value)) - F.lit(53)) / F.lit(_BITS)).cast("int")
    head = (value / F.pow(F.lit(2.0), times * F.lit(_BITS))).try_cast("bigint")
    none = F.lit(0).cast("bigint")
    limbs = F.array(head % base, F.call_function("div", head, base), *[none] * (_LIMBS - 2))

    def shifted(limbs: Column, _: Column) -> Column:
        def moved(x: Column, i: Column) -> Column:
            carry = F.call_function("div", F.get(limbs, i - F.lit(1)) * shift, base)
            return x * shift % base + F.coalesce(carry, none)

        return F.transform(limbs, moved)

    grown = F.aggregate(F.sequence(F.lit(1), times), limbs, shifted)
    shown = F.transform(F.reverse(grown), lambda x: F.lpad(x.cast("string"), _LIMB, "0"))
    return F.regexp_replace(F.array_join(shown, ""), "^0+", "")


def fixed_value(value: Column, decimals: int = 6) -> Column:
    """The number a reader gets back from :func:`fixed`."""
    return fixed(value, decimals).cast("double")


def general(value: Column) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g`` prints them."""
    value = value.cast("double")
    shape = F.call_function("format_number", value, F.lit("0.00000E0"))
    exponent = F.substring_index(shape, "E", -1).cast("int")
    text = None
    for power in range(-4, 6):
        pattern = "0." + "#" * (5 - power) if power < 5 else "0"
        digits = F.call_function("format_number", value, F.lit(pattern))
        here = exponent == power
        text = F.when(here, digits) if text is None else text.when(here, digits)
    scientific = F.regexp_replace(
        F.call_function("format_number", value, F.lit("0.#####E00")), r"E(?=\d)", "E+"
    )
    return F.when(value == 0, "0").otherwise(text.otherwise(F.lower(scientific)))


def rank_tone(rank: Column) -> Column:
    tone = F
    for last, label in TONES:
        tone = tone.when(rank <= last, label)
    return tone.otherwise(LAST_TONE)


def python_bool(value: Column) -> Column:
    """``True`` / ``False`` as they are printed in the profile cards."""
    return F.when(value, "True").when(~value, "False")
