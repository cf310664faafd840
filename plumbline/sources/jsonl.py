"""Line-oriented JSON: tolerant reading with reject tables, ordered append logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cleaning import coerce_signal, coerce_text, is_json, object_rows
from plumbline.functions.scalar import strip
from plumbline.operators.ordering import last_per_key
from plumbline.schema import SIGNALS, record_fields, record_schema


class RecordLoadError(ValueError):
    """A line of a record file is not JSON."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with ``source_order``.

    Spark knows no line numbers, but blocks of a file start at known offsets and a
    task reads its block in order, so (modification time, file, block, row in task)
    orders the lines of a log across splits and across appended files.
    """
    raw = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("source_order"),
    )
    return raw.withColumn("value", strip(F.col("value"))).filter("value <> ''")


def not_blank(line: Column) -> Column:
    return strip(line) != ""


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines, without parsing them."""
    return spark.read.text(path).filter(not_blank(F.col("value"))).count()


def rejects(parsed_lines: DataFrame) -> DataFrame:
    """(path, text) of the lines that are not JSON."""
    bad = parsed_lines.filter(~is_json(F.col("value")))
    return bad.select(F.col("source_order.file").alias("path"), F.col("value").alias("text"))


def read_records(
    spark: SparkSession,
    path: str,
    skip_errors: bool = False,
    id_field: str = "id",
    activity_field: str = "activity",
) -> DataFrame:
    """Records with an explicit schema and ``source_order``.

    A line is rejected when it is not JSON; a single field of the wrong type is only
    null. Rejected lines raise unless ``skip_errors``.
    """
    text = lines(spark, path)
    if not skip_errors:
        first = rejects(text).limit(1).collect()
        if first:
            raise RecordLoadError(f"{first[0]['path']}: not JSON: {first[0]['text'][:200]}")
    schema = record_schema(id_field, activity_field)
    fields = record_fields(id_field, activity_field)
    good = text.filter(is_json(F.col("value")))
    parsed = good.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    renamed = {id_field: "id", activity_field: "activity"}
    return parsed.select(
        *[F.col(f"r.{name}").alias(renamed.get(name, name)) for name in fields],
        "source_order",
    )


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """Parsed object lines of a log; None when there is no log yet."""
    try:
        text = lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return object_rows(text, "value").select("source_order", "record")


def latest_records(
    log: DataFrame, columns: dict[str, Column], keep: Column, judged: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Typed log lines, the last one of every id.

    ``keep`` reads the columns in ``judged``; the others are typed for the last lines alone.
    """
    kept = log.select("source_order", "record", *[columns[n].alias(n) for n in judged]).filter(keep)
    latest = last_per_key(kept.select("id", "source_order", "record"), "id", F.col("source_order"))
    return latest.select("id", *[c.alias(n) for n, c in columns.items() if n != "id"])


def read_signals(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """Signal log: every line coerced again, broken lines skipped, the last line wins."""
    log = _log(spark, path)
    if log is None:
        return spark.createDataFrame([], SIGNALS)
    return latest_records(log, coerce_signal(F.col("record"), id_field), F.col("id") != "")


def read_texts(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """Explanation log (id, text, source): as the signal log, empty texts skipped."""
    log = _log(spark, path)
    if log is None:
        return spark.createDataFrame([], "id string, text string, source string")
    wanted = (F.col("id") != "") & (F.col("text") != "")
    return latest_records(log, coerce_text(F.col("record"), id_field), wanted, ("id", "text"))


def append_records(df: DataFrame, path: str) -> None:
    """Append one batch of records, one JSON object per line."""
    df.write.mode("append").json(path)


def flag_ids(text: Column) -> Column:
    """The keys of one object, or of one object in each line; [] for another kind of JSON."""
    kind = "map<string,variant>"
    none = F.array().cast("array<string>")
    rows = F.split(strip(text), "\n")
    by_line = F.flatten(
        F.transform(rows, lambda row: F.coalesce(F.map_keys(F.from_json(row, kind)), none))
    )
    whole = F.coalesce(F.map_keys(F.from_json(strip(text), kind)), none)
    # Lines have an object in the first of them; another text holds one object.
    is_lines = F.from_json(F.get(rows, F.lit(0)), kind).isNotNull()
    keyed = F.when(is_lines, by_line).otherwise(whole)
    return F.when(strip(text).startswith("{"), keyed).otherwise(none)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Ids of objects keyed by id, one for a file or one for a line; the values do not count.

    A missing file or another kind of JSON gives no ids.
    """
    empty = spark.createDataFrame([], "id string")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return text.select(F.explode(flag_ids(F.col("value"))).alias("id")).distinct()


def write_flags(flags: DataFrame, path: str) -> None:
    """Flag records (id, reasons) in id order, one object keyed by id per line."""
    record = F.struct(F.lit(True).alias("honeypot"), F.col("reasons"))
    line = F.to_json(F.create_map(F.col("id"), record)).alias("value")
    flags.orderBy("id").select(line).write.mode("overwrite").text(path)
