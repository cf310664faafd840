"""Data-quality checks: every violation is a row, nothing stops at the first one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import squeeze, strip
from plumbline.operators.durable import durable
from plumbline.schema import RUBRIC_LISTS

OUTPUT_COLUMNS = ("id", "rank", "score", "reasoning")
ID_PATTERN = r"^[A-Z]+_[0-9]{7,}$"
FLOAT_TEXT = r"^[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?$"


class ConstraintError(ValueError):
    """A constraint that must hold before the work may go on does not hold."""


def violation(df: DataFrame, check: str, row: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), row.cast("string").alias("row"),
        detail.cast("string").alias("detail"),
    )


def flaw(check: str, bad: Column, row: Column, detail: Column) -> Column:
    """One violation as a struct, null where the row is fine."""
    parts = {"check": F.lit(check), "row": row.cast("string"), "detail": detail.cast("string")}
    return F.when(bad, F.struct(*[value.alias(name) for name, value in parts.items()]))


def row_flaws(rows: DataFrame, *flaws: Column) -> DataFrame:
    """Every violation that shows in a row by itself, in one pass."""
    # Nulls go after the generator: a lambda over the array would leave whole-stage codegen.
    return rows.select(F.inline(F.array(*flaws))).filter("check IS NOT NULL")


def _typed(rows: DataFrame) -> DataFrame:
    """Adds the stripped id and the rank as a number, so that they are worked out once."""
    return rows.withColumns({"_name": strip(F.col("id")),
                             "_place": canonical_rank(strip(F.col("rank")))})


def row_count(rows: DataFrame, expected: int) -> DataFrame:
    counted = rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
    return violation(counted, "row_count", F.lit("all"), F.col("n"))


def _blank_id() -> Column:
    return flaw("id_missing", F.col("_name") == "", F.col("rank"), F.col("id"))


def _odd_id(pattern: str) -> Column:
    bad = (F.col("_name") != "") & ~F.col("_name").rlike(pattern)
    return flaw("id_pattern", bad, F.col("rank"), F.col("id"))


def id_missing(rows: DataFrame) -> DataFrame:
    return row_flaws(_typed(rows), _blank_id())


def id_pattern(rows: DataFrame, pattern: str = ID_PATTERN) -> DataFrame:
    return row_flaws(_typed(rows), _odd_id(pattern))


def id_duplicates(rows: DataFrame, pattern: str = ID_PATTERN) -> DataFrame:
    """Well-formed ids that occur more than once."""
    formed = rows.select(strip(F.col("id")).alias("id")).filter(F.col("id").rlike(pattern))
    bad = formed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violation(bad, "id_duplicate", F.col("id"), F.col("n"))


def canonical_rank(rank: Column) -> Column:
    """The rank as a number when its text is exactly how that number is written."""
    number = rank.try_cast("bigint")
    return F.when(number.cast("string") == rank, number)


def _odd_rank() -> Column:
    return flaw("rank_format", F.col("_place").isNull(), F.col("rank"), F.col("id"))


def _far_rank(n: int) -> Column:
    return flaw("rank_range", ~F.col("_place").between(1, n), F.col("rank"), F.col("id"))


def rank_format(rows: DataFrame) -> DataFrame:
    return row_flaws(_typed(rows), _odd_rank())


def rank_range(rows: DataFrame, n: int) -> DataFrame:
    return row_flaws(_typed(rows), _far_rank(n))


def rank_duplicates(rows: DataFrame, n: int) -> DataFrame:
    """Ranks in range that occur more than once."""
    ranks = rows.select(canonical_rank(strip(F.col("rank"))).alias("r")).filter(
        F.col("r").between(1, n)
    )
    counted = ranks.groupBy("r").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return violation(counted, "rank_duplicate", F.col("r"), F.col("k"))


def rank_missing(rows: DataFrame, n: int) -> DataFrame:
    wanted = rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "r")
    found = rows.select(canonical_rank(strip(F.col("rank"))).alias("r"))
    return violation(wanted.join(found, "r", "left_anti"), "rank_missing", F.col("r"), F.lit(""))


def _odd_score() -> Column:
    bad = F.coalesce(~_is_float(F.col("score")), F.lit(True))
    return flaw("score_format", bad, F.col("rank"), F.col("score"))


def score_format(rows: DataFrame) -> DataFrame:
    return row_flaws(rows, _odd_score())


def _is_float(text: Column) -> Column:
    """Text that reads as a float, including nan and infinity."""
    special = F.lower(strip(text)).rlike(r"^[+-]?(inf|infinity|nan)$")
    return strip(text).rlike(FLOAT_TEXT) | special


def score_order(rows: DataFrame) -> DataFrame:
    """Neighbours by rank whose scores rise, or whose ids fall at equal scores.

    Rows are cut into ranges of (rank, id); neighbours meet within a range, and the last row
    of a range meets the first of the next one. Only flawed pairs and the ends of the ranges
    are stored, two rows for a range.
    """
    typed = _typed(rows).select(
        F.col("_place").alias("r"), F.col("score").try_cast("double").alias("s"),
        F.col("_name").alias("id"),
    ).filter("r IS NOT NULL AND s IS NOT NULL AND id <> ''")
    ranges = typed.repartitionByRange("r", "id").withColumn("slot", F.spark_partition_id())
    order = Window.partitionBy("slot").orderBy("r", "id")
    following = F.lead(F.struct("r", "s", "id")).over(order)
    first = F.lag("r").over(order).isNull()
    paired = ranges.withColumns({"after": following, "first": first})
    flawed = (F.col("s") < F.col("after.s")) | (
        (F.col("s") == F.col("after.s")) & (F.col("id") > F.col("after.id"))
    )
    last = F.col("after").isNull()
    held = durable(paired.filter(F.col("first") | last | flawed))
    ends = held.filter(F.col("first") | last).withColumn("last", last)
    across = Window.orderBy("slot", "r", "id", "last")  # two rows for a range, not more
    met = ends.withColumn("after", F.lead(F.struct("r", "s", "id")).over(across)).filter("last")
    both = held.select("s", "id", "after").unionByName(met.select("s", "id", "after"))
    return row_flaws(
        both,
        flaw("score_order", F.col("s") < F.col("after.s"), F.col("after.r"), F.concat_ws(
            " < ", F.col("s").cast("string"), F.col("after.s").cast("string"))),
        flaw("tie_order", (F.col("s") == F.col("after.s")) & (F.col("id") > F.col("after.id")),
             F.col("after.r"), F.concat_ws(" > ", "id", "after.id")),
    )


def key_flaws(rows: DataFrame, n: int, pattern: str = ID_PATTERN) -> DataFrame:
    """Repeated ids and ranks, absent ranks and a wrong number of rows, from one count by key.

    The wanted ranks join the count with a weight of zero, so no second pass looks for them.
    """

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("key"))

    name, place = F.col("_name"), F.col("_place")
    keys = F.array(
        key("row_count", F.lit("all")),
        F.when(name.rlike(pattern), key("id_duplicate", name)),
        F.when(place.between(1, n), key("rank_duplicate", place)),
    )
    listed = _typed(rows).select(F.inline(keys)).filter("kind IS NOT NULL")
    found = listed.withColumn("found", F.lit(1))
    wanted = rows.sparkSession.range(0, n + 1).select(
        F.when(F.col("id") == 0, "row_count").otherwise("rank_duplicate").alias("kind"),
        F.when(F.col("id") == 0, "all").otherwise(F.col("id").cast("string")).alias("key"),
        F.lit(0).alias("found"),
    )
    counted = found.unionByName(wanted).groupBy("kind", "key").agg(F.sum("found").alias("n"))
    check = (
        F.when(F.col("kind") == "row_count", F.when(F.col("n") != n, F.col("kind")))
        .when(F.col("n") == 0, "rank_missing").when(F.col("n") > 1, F.col("kind"))
    )
    detail = F.when(F.col("check") == "rank_missing", "").otherwise(F.col("n").cast("string"))
    return counted.withColumn("check", check).filter("check IS NOT NULL").select(
        "check", F.col("key").alias("row"), detail.alias("detail")
    )


def output_violations(rows: DataFrame, n: int, pattern: str = ID_PATTERN) -> DataFrame:
    """Every violation of a ranked output given as text columns id, rank, score."""
    by_row = row_flaws(
        _typed(rows), _blank_id(), _odd_id(pattern), _odd_rank(), _far_rank(n), _odd_score()
    )
    return by_row.unionByName(key_flaws(rows, n, pattern)).unionByName(score_order(rows))


def vector_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that must not be written: no id, no vector, wrong length, repeated id."""
    embedding, nothing = F.col("embedding"), F.lit("")
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.size(embedding).alias("n"),
                          embedding.isNull().alias("empty"))
    by_row = row_flaws(
        rows,
        flaw("id_missing", F.coalesce("id", nothing) == "", nothing, nothing),
        flaw("vector_missing", F.col("empty"), F.col("id"), nothing),
        flaw("vector_size", ~F.col("empty") & (F.col("n") != dim), F.col("id"), F.col("n")),
    )
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return by_row.unionByName(violation(repeated, "id_duplicate", F.col("id"), F.col("k")))


def dimension_mismatches(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: pool vectors whose length differs from the reference vector's."""
    expected = reference.select(F.size("embedding")).scalar()
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("embedding") != expected).alias("mismatched"),
    )


def require_none(violations: DataFrame, what: str) -> None:
    """Fail with the first few violations; only those few are fetched."""
    first = violations.limit(5).collect()
    if first:
        shown = "; ".join(f"{v['check']} {v['row']} {v['detail']}".strip() for v in first)
        raise ConstraintError(f"{what}: {shown}")


def rubric_issues(record: Column) -> Column:
    """What is wrong with a rubric record given as a variant; empty when it is usable."""
    rubric = F.try_variant_get(record, "$.rubric", "variant")
    kind = F.coalesce(F.schema_of_variant(rubric).startswith("OBJECT"), F.lit(False))
    issues = []
    for name in RUBRIC_LISTS:
        value = F.try_variant_get(record, f"$.rubric.{name}", "variant")
        is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
        issues += [
            F.when(kind & ~is_list, f"rubric.{name} must be a list"),
            F.when(kind & is_list & (F.size(_texts(value)) == 0), f"rubric.{name} is empty"),
        ]
    band = F.try_variant_get(record, "$.rubric.seniority_band", "variant")
    has_band = F.coalesce(F.schema_of_variant(band).startswith("OBJECT"), F.lit(False))
    issues.append(F.when(kind & ~has_band, "rubric.seniority_band must be an object"))
    for name in ("min_years", "max_years"):
        value = F.try_variant_get(record, f"$.rubric.seniority_band.{name}", "variant")
        type_name = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        numeric = type_name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        issues.append(
            F.when(kind & has_band & ~numeric, f"seniority_band.{name} must be a number")
        )
    listed = F.array_compact(F.array(*issues))
    is_record = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    no_text = F.when(ideal_text(record) == "", "the ideal text is missing")
    return (
        F.when(~is_record, F.array(F.lit("not a JSON object")))
        .when(~kind, F.array_compact(F.array(F.lit("the rubric object is missing"), no_text)))
        .otherwise(F.array_compact(F.concat(listed, F.array(no_text))))
    )


def _texts(items: Column) -> Column:
    members = F.try_variant_get(items, "$", "array<variant>")
    cleaned = F.transform(members, lambda m: squeeze(F.try_variant_get(m, "$", "string")))
    return F.coalesce(F.filter(cleaned, lambda t: t != ""), F.array().cast("array<string>"))


def ideal_text(record: Column, keys: Sequence[str] = ("ideal_candidate_description",
                                                      "ideal_text")) -> Column:
    """The ideal text under the first key that has one, squeezed; '' if none has."""
    found = []
    for key in keys:
        value = F.try_variant_get(record, f"$.{key}", "variant")
        text = squeeze(F.try_variant_get(value, "$", "string"))
        found.append(F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text))
    return F.coalesce(*found, F.lit(""))


def typed_rubric(record: Column) -> Column:
    """The rubric as a struct of clean lists and a numeric band."""
    lists = [
        _texts(F.try_variant_get(record, f"$.rubric.{name}", "variant")).alias(name)
        for name in RUBRIC_LISTS
    ]
    band = "$.rubric.seniority_band"
    notes = F.try_variant_get(record, f"{band}.notes", "string")
    seniority = F.struct(
        F.try_variant_get(record, f"{band}.min_years", "double").alias("min_years"),
        F.try_variant_get(record, f"{band}.max_years", "double").alias("max_years"),
        F.when(notes.isNotNull(), squeeze(notes)).alias("notes"),
    )
    return F.struct(*lists, seniority.alias("seniority_band"))

