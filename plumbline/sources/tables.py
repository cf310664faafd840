"""Vectors, id lists, reference records, gold labels and report files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import MetricSettings, VectorSettings
from plumbline.functions.cleaning import is_object
from plumbline.functions.scalar import strip
from plumbline.functions.vector import narrow, norm
from plumbline.operators.checks import (
    OUTPUT_COLUMNS,
    ConstraintError,
    ideal_text,
    require_none,
    rubric_issues,
    typed_rubric,
    vector_violations,
)
from plumbline.operators.durable import durable
from plumbline.operators.membership import restrict
from plumbline.operators.ordering import last_per_key, require_rows
from plumbline.sources.jsonl import lines


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding); any number of files make one table, aligned by id."""
    return spark.read.parquet(path).select("id", "embedding")


def write_vectors(vectors: DataFrame, path: str, dim: int, append: bool = False) -> None:
    """Store checked vectors; an overwrite leaves no file of an earlier run behind."""
    require_none(vector_violations(vectors, dim), "vectors not written")
    stored = vectors.select("id", narrow(F.col("embedding")).alias("embedding"))
    stored.write.mode("append" if append else "overwrite").parquet(path)


def manifest(vectors: DataFrame, settings: VectorSettings, source: str) -> DataFrame:
    """One provenance row: what was measured on the vectors and how they were made."""
    size, length = F.size("embedding"), norm(F.col("embedding"))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(size).alias("min_dim"), F.max(size).alias("max_dim"),
        F.min(length).alias("min_norm"), F.max(length).alias("max_norm"),
    ).select(
        F.lit(settings.model_id).alias("model_id"), F.lit(settings.dim).alias("dim"), "n",
        "min_dim", "max_dim", "min_norm", "max_norm", F.lit(source).alias("source"),
        F.lit(settings.passage_prefix).alias("passage_prefix"),
        F.lit(settings.query_prefix).alias("query_prefix"),
    )


def write_manifest(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON array file or of an id table; a missing path is an error."""
    text = spark.read.text(path, wholetext=True)
    ids = F.from_json(strip(F.col("value")), "array<string>")
    listed = text.filter(strip(F.col("value")).startswith("[")).select(F.explode(ids).alias("id"))
    rows = text.filter(~strip(F.col("value")).startswith("[")).select(
        F.explode(F.split("value", r"\n")).alias("line")
    )
    from_rows = rows.filter(strip(F.col("line")) != "").select(
        F.get_json_object("line", "$.id").alias("id")
    )
    return listed.unionByName(from_rows).distinct()


def write_ids(ids: DataFrame, path: str) -> None:
    """Sorted ids, one JSON object per line."""
    ids.select("id").orderBy("id").write.mode("overwrite").json(path)


def reference_fields(record: Column) -> dict[str, Column]:
    """Typed columns of a reference record given as a variant; ``ok``: it is an object."""
    vector = F.try_variant_get(record, "$.reference_embedding", "array<double>")
    return {
        "ok": F.coalesce(is_object(record), F.lit(False)), "rubric": typed_rubric(record),
        "ideal_text": ideal_text(record), "embedding": vector,
    }


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """The one reference record: (rubric, ideal_text, embedding, embedding_dim)."""
    text = spark.read.text(path, wholetext=True).withColumn("r", F.try_parse_json("value"))
    rows = text.select(*[c.alias(n) for n, c in reference_fields(F.col("r")).items()])
    checked = rows.limit(2).collect()
    if len(checked) != 1 or not checked[0]["ok"]:
        raise ConstraintError(f"{path} is not one JSON object")
    if not checked[0]["embedding"]:
        raise ConstraintError(f"{path} has no reference vector")
    return rows.drop("ok").withColumn("embedding_dim", F.size("embedding"))


def write_reference(reference: DataFrame, path: str) -> None:
    """One record with its derived dimension, as one JSON line."""
    named = reference.withColumn("embedding_dim", F.size("embedding")).withColumnRenamed(
        "embedding", "reference_embedding"
    )
    named.coalesce(1).write.mode("overwrite").json(path)


def validated_rubrics(replies: DataFrame) -> DataFrame:
    """(…, rubric, ideal_text, issues) for rubric replies given as variant ``record``."""
    record = F.col("record")
    return replies.withColumns(
        {
            "issues": rubric_issues(record),
            "rubric": typed_rubric(record),
            "ideal_text": ideal_text(record),
        }
    )


def read_gold(spark: SparkSession, path: str, settings: MetricSettings,
              id_field: str = "candidate_id") -> DataFrame:
    """(id, tier, note). Unlabelled rows are skipped, a bad tier is fatal, the last id wins."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn(
        "_line", F.monotonically_increasing_id()
    )
    for column in (id_field, "tier"):
        if column not in raw.columns:
            raise ConstraintError(f"{path}: missing required column {column}")
    typed = labelled_rows(raw, id_field)
    bad = bad_tiers(typed, settings).limit(1).collect()
    if bad:
        raise ConstraintError(f"{path}: {bad[0]['id']}: bad tier {bad[0]['tier_text']!r}")
    return last_labels(typed)


def labelled_rows(raw: DataFrame, id_field: str) -> DataFrame:
    """(id, tier_text, note, _line, tier) of the rows of a gold sheet that have a label."""
    note = strip(F.col("note")) if "note" in raw.columns else F.lit("")
    rows = raw.select(
        strip(F.col(id_field)).alias("id"), strip(F.col("tier")).alias("tier_text"),
        note.alias("note"), "_line",
    ).filter("id <> '' AND tier_text <> ''")
    whole = F.col("tier_text").rlike(r"^[+-]?\d+$")
    return rows.withColumn("tier", F.when(whole, F.col("tier_text").try_cast("int")))


def bad_tiers(labelled: DataFrame, settings: MetricSettings) -> DataFrame:
    """Labels that are no whole number of the scale."""
    return labelled.filter(
        F.col("tier").isNull() | ~F.col("tier").between(0, settings.max_tier)
    )


def last_labels(labelled: DataFrame) -> DataFrame:
    """(id, tier, note): the last label of every id."""
    rows = labelled.select("id", "tier", "note", "_line")
    return last_per_key(rows, "id", F.col("_line")).drop("_line")


def write_ranked(rows: DataFrame, path: str, top_n: int) -> None:
    """The ranked cut as one CSV file with a fixed header, in rank order.

    ``rows`` is a cut of ``top_n`` rows, so one writer task suffices.
    """
    full = require_rows(durable(rows), top_n)
    ordered = full.coalesce(1).sortWithinPartitions("rank").select(*OUTPUT_COLUMNS)
    ordered.write.mode("overwrite").csv(
        path, header=True, lineSep="\n", escape='"', encoding="UTF-8", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """A ranked CSV as text columns, whatever it holds."""
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def header_violations(spark: SparkSession, path: str) -> DataFrame:
    """A header other than the expected one, or rows with another number of columns."""
    expected = ",".join(OUTPUT_COLUMNS)
    first = lines(spark, path).orderBy("source_order").limit(1)
    head = first.filter(F.col("value") != expected).select(
        F.lit("header").alias("check"), F.lit("1").alias("row"), F.col("value").alias("detail")
    )
    rows = spark.read.csv(path, schema=FIELDS, header=False, multiLine=True, **FIELD_OPTIONS)
    return head.unionByName(uneven_rows(rows))


#: The fields of a row; a row with another number of them is kept whole in ``_uneven``.
FIELDS = ", ".join([f"_c{i} string" for i in range(len(OUTPUT_COLUMNS))] + ["_uneven string"])
FIELD_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_uneven"}


def uneven_rows(rows: DataFrame) -> DataFrame:
    """The rows of FIELDS that have another number of columns than the output."""
    # Spark refuses a scan of the kept rows alone (a count, say), so a field is read with them.
    both = F.concat("_uneven", F.coalesce("_c0", F.lit("")))
    return rows.filter(F.length(both) > 0).select(
        F.lit("column_count").alias("check"), F.col("_c0").alias("row"),
        F.lit(str(len(OUTPUT_COLUMNS))).alias("detail"),
    )


def write_report(row: DataFrame, path: str) -> None:
    """One metrics row as JSON with sorted keys and no clock."""
    row.coalesce(1).select(report_line(row.columns)).write.mode("overwrite").text(path)


def report_line(columns: Sequence[str]) -> Column:
    """The columns as one JSON object with sorted keys."""
    return F.to_json(F.struct(*sorted(columns))).alias("value")


def write_sheet(sheet: DataFrame, path: str) -> None:
    """The review sheet: a sample of bounded size, so one file."""
    sheet.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_cards(lines: DataFrame, path: str) -> None:
    """Headings and cards (category, place, id, value) as one file: a bounded sample."""
    ordered = lines.coalesce(1).sortWithinPartitions("category", "place", "id")
    ordered.select("value").write.mode("overwrite").text(path)


def mirror(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table cut to the ids, in id order."""
    return {name: restrict(table, ids).orderBy("id") for name, table in tables.items()}


def coverage_gaps(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(artifact, found, missing) per mirrored table."""
    total = ids.select("id").distinct().agg(F.count(F.lit(1))).scalar()
    parts = [
        restrict(ids.select("id").distinct(), table)
        .agg(F.count(F.lit(1)).alias("found"))
        .select(F.lit(name).alias("artifact"), "found", (total - F.col("found")).alias("missing"))
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
