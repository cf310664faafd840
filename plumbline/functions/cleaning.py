"""Column functions that turn noisy generated text into typed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import (
    DEFAULT_DOMAIN,
    DEFAULT_ROLE,
    DOMAINS,
    FLAGS,
    NEUTRAL,
    ROLES,
)
from plumbline.functions.scalar import clip01, squeeze, strip

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FENCE = "```"


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def strip_fence(text: Column) -> Column:
    """Content of the first code fence (to the end if it is never closed), else the text."""
    lines = _lines(text)
    marked = F.transform(
        lines, lambda line, i: F.when(F.ltrim(line).startswith(FENCE), i)
    )
    fences = F.array_compact(marked)
    first, second = F.get(fences, F.lit(0)), F.get(fences, F.lit(1))
    last = F.coalesce(second, F.size(lines))
    inside = F.array_join(F.slice(lines, first + 2, last - first - 1), "\n")
    return F.when(F.size(fences) == 0, text).otherwise(inside)


def first_balanced(text: Column) -> Column:
    """The first complete object or array, ignoring brackets inside JSON strings.

    One pass over the characters with a small state (depth, inside a string, after a
    backslash); only brackets of the opener's kind count. Meant for the rows that do
    not parse as they are.
    """
    brace, bracket = F.locate("{", text), F.locate("[", text)
    start = F.least(F.nullif(brace, F.lit(0)), F.nullif(bracket, F.lit(0)))
    rest = F.substring(text, start, F.length(text))
    opener = F.substring(rest, 1, 1)
    closer = F.when(opener == "{", "}").otherwise("]")
    chars = F.regexp_extract_all(rest, F.lit("(?s)(.)"), F.lit(1))
    state = F.struct(
        F.lit(0).alias("seen"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"),
        F.lit(False).alias("escaped"), F.lit(0).alias("stop"), opener.alias("opener"),
        closer.alias("closer"),
    )

    def step(s: Column, c: Column) -> Column:
        plain = ~s["quoted"]
        depth = (
            F.when(plain & (c == s["opener"]), s["depth"] + 1)
            .when(plain & (c == s["closer"]), s["depth"] - 1)
            .otherwise(s["depth"])
        )
        seen = s["seen"] + 1
        closed = plain & (c == s["closer"]) & (depth == 0)
        following = F.struct(
            seen.alias("seen"),
            depth.alias("depth"),
            F.when(plain, c == '"')
            .when(s["escaped"], True)
            .otherwise(c != '"')
            .alias("quoted"),
            (~plain & ~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when(closed, seen).otherwise(0).alias("stop"),
            s["opener"].alias("opener"),
            s["closer"].alias("closer"),
        )
        return F.when(s["stop"] > 0, s).otherwise(following)

    stop = F.aggregate(chars, state, step)["stop"]
    return F.when(stop > 0, F.substring(rest, F.lit(1), stop))


def is_json(text: Column) -> Column:
    """The whole text is one JSON value.

    ``try_parse_json`` stops after the first value. Inside both an array and an
    object that leniency is gone: text that could end one wrapper early breaks the other.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    return F.coalesce(one & in_object.isNotNull(), F.lit(False))


def json_object(text: Column) -> Column:
    """The object that the whole text is, as a variant; null for anything else.

    As :func:`is_json`, but the value comes from the same two readings.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    return F.get(F.filter(F.array(F.when(one, field(in_object, "v"))), is_object), F.lit(0))


def object_rows(lines: DataFrame, text: str, name: str = "record") -> DataFrame:
    """The rows whose text is one object, with the object in ``name``; each text is read once.

    A filter on the parsed column would move below it and parse again, so rows go as an
    ``explode`` of no or one value.
    """
    others = [column for column in lines.columns if column != name]
    return lines.select(*others, F.explode(F.array_compact(F.array(json_object(F.col(text)))))
                        .alias(name))


def with_json_text(df: DataFrame, reply: str, name: str = "json") -> DataFrame:
    """Add the JSON inside a reply (plain, fenced or wrapped in prose), null if none.

    The steps are columns of their own, so each is computed once, and the character
    scan runs only for replies that do not parse as they are.
    """
    staged = df.withColumn("_cleaned", strip(strip_fence(F.col(reply))))
    staged = staged.withColumn("_direct", is_json(F.col("_cleaned")))
    staged = staged.withColumn(
        "_snippet", F.when(~F.col("_direct"), first_balanced(F.col("_cleaned")))
    )
    found = F.when(F.col("_direct"), F.col("_cleaned")).when(
        is_json(F.col("_snippet")), F.col("_snippet")
    )
    return staged.withColumn(name, found).drop("_cleaned", "_direct", "_snippet")


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(_type(value).startswith("OBJECT"), F.lit(False))


def field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def records(text: Column, required: Sequence[str]) -> Column:
    """JSON text to an array of records.

    Accepts an array, one bare record (an object with the required keys) or an object
    whose first list, in the order it was written, holds the records.
    """
    value = F.try_parse_json(text)
    has_all = F.lit(True)
    for name in required:
        has_all = has_all & field(value, name).isNotNull()
    members = F.map_values(F.from_json(text, "map<string,variant>"))
    lists = F.filter(members, lambda m: _type(m).startswith("ARRAY"))
    wrapped = F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>")
    nothing = F.array().cast("array<variant>")
    return (
        F.when(_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        .when(is_object(value) & has_all, F.array(value))
        .when(is_object(value), F.coalesce(wrapped, nothing))
        .otherwise(nothing)
    )


def normalize_word(label: Column, allowed: Sequence[str], default: str) -> Column:
    """Lower case, separators to underscores; unknown words become the default."""
    spaced = F.regexp_replace(F.lower(label), "[-/]", " ")
    key = F.replace(squeeze(spaced), F.lit(" "), F.lit("_"))
    return F.when(key.isin(*allowed), key).otherwise(default)


def unit_number(number: Column) -> Column:
    """A number (or numeric text) clamped to [0, 1]; anything else is neutral."""
    return F.coalesce(clip01(number.try_cast("double")), F.lit(NEUTRAL))


def truthy_word(word: Column) -> Column:
    return F.lower(strip(word)).isin("true", "yes", "y", "1")


def variant_bool(value: Column) -> Column:
    kind = _type(value)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", truthy_word(F.try_variant_get(value, "$", "string")))
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def variant_word(value: Column, allowed: Sequence[str], default: str) -> Column:
    text = F.when(_type(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(normalize_word(text, allowed, default), F.lit(default))


def clean_flags(labels: Column) -> Column:
    """Known flags only, distinct and sorted; null becomes an empty array."""
    known = F.filter(
        F.transform(labels, lambda x: normalize_word(x, FLAGS, "")), lambda x: x != ""
    )
    return F.coalesce(F.sort_array(F.array_distinct(known)), F.array().cast("array<string>"))


def variant_flags(value: Column) -> Column:
    items = F.when(
        _type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )
    texts = F.filter(
        F.transform(items, lambda x: F.when(_type(x) == "STRING", F.try_variant_get(
            x, "$", "string"))),
        lambda x: x.isNotNull(),
    )
    return clean_flags(texts)


def coerce_signal(record: Column, id_field: str = "id") -> dict[str, Column]:
    """Typed signal columns of one record; ``id`` is '' when it has none."""
    return {
        "id": squeeze(field(record, id_field, "string")),
        "role_archetype": variant_word(field(record, "role_archetype"), ROLES, DEFAULT_ROLE),
        "domain": variant_word(field(record, "domain"), DOMAINS, DEFAULT_DOMAIN),
        "product_vs_services": F.coalesce(
            clip01(field(record, "product_vs_services", "double")), F.lit(NEUTRAL)
        ),
        "seniority_band_fit": F.coalesce(
            clip01(field(record, "seniority_band_fit", "double")), F.lit(NEUTRAL)
        ),
        "built_ranking_or_search": variant_bool(field(record, "built_ranking_or_search")),
        "evidence_span": squeeze(field(record, "evidence_span", "string")),
        "disqualifier_flags": variant_flags(field(record, "disqualifier_flags")),
    }


def coerce_text(record: Column, id_field: str = "id") -> dict[str, Column]:
    """Typed columns of one explanation record."""
    source = field(record, "source", "string")
    return {
        "id": F.when(_type(field(record, id_field)) == "STRING",
                     squeeze(field(record, id_field, "string"))).otherwise(""),
        "text": squeeze(field(record, "reasoning", "string")),
        "source": text_source(source),
    }


def text_source(source: Column) -> Column:
    return F.when(source.isin("llm", "deterministic"), source).otherwise("llm")
