"""Counts and histograms of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import strip
from plumbline.operators.membership import exclude

BAR_UNITS = 40


def branch_counts(survivors: DataFrame) -> DataFrame:
    return survivors.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Count, share and bar length per value; order by count desc, then value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("n") / F.col("_total")
    return counts.withColumn("_total", total).select(
        "value", "n", share.alias("share"),
        F.bround(F.lit(float(BAR_UNITS)) * F.col("n") / F.col("_total")).cast("int").alias("bar"),
    )


def member_histogram(df: DataFrame, column: str) -> DataFrame:
    """Count per array element and its share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = (
        df.select(F.explode(column).alias("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("share", F.col("n") / total)


def true_rate(df: DataFrame, condition: Column) -> DataFrame:
    hits = F.count_if(condition)
    return df.agg(
        hits.alias("n_true"), F.count(F.lit(1)).alias("n"),
        F.try_divide(hits, F.count(F.lit(1))).alias("rate"),
    )


def reason_histogram(flags: DataFrame) -> DataFrame:
    return (
        flags.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_ids(flags: DataFrame, n: int = 5) -> DataFrame:
    return flags.orderBy("id").limit(n)


def scan_counts(pool: DataFrame, flags: DataFrame) -> DataFrame:
    flagged = flags.agg(F.count(F.lit(1))).scalar()
    return pool.agg(F.count(F.lit(1)).alias("total")).withColumn("flagged", flagged)


def top_summary(top: DataFrame) -> DataFrame:
    return top.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("impossible").alias("impossible"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
        F.min("availability").alias("lowest_availability"),
        F.max("availability").alias("highest_availability"),
    )


def text_counts(texts: DataFrame) -> DataFrame:
    """Provenance, missing texts and failed checks of (text, source, issues) rows."""
    present = F.col("text").isNotNull()
    return texts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(present & (F.col("source") == "llm")).alias("generated"),
        F.count_if(present & (F.col("source") == "deterministic")).alias("computed"),
        F.count_if(~present).alias("missing"),
        F.count_if(present & (F.size("issues") > 0)).alias("failed"),
    )


def duplicate_count(df: DataFrame, text: str) -> DataFrame:
    """Rows beyond the first of every distinct trimmed, lower-cased text."""
    # Long texts are grouped by their digest.
    key = F.sha2(F.lower(strip(F.col(text))), 256)
    per_text = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def gap_honesty(texts: DataFrame) -> DataFrame:
    """Rows with a gap, and how many of them mention one."""
    has_gap = F.size("gaps") > 0
    return texts.agg(
        F.count_if(has_gap).alias("with_gap"),
        F.count_if(has_gap & F.col("mentions_gap")).alias("disclosed"),
    )


def category_counts(picks: DataFrame) -> DataFrame:
    return picks.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("pick").alias("first_pick")
    )


def coverage(**tables: DataFrame) -> DataFrame:
    """One row per loaded table with its row count."""
    counted = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n")
        counted = row if counted is None else counted.unionByName(row)
    return counted


def lost_ids(requested: DataFrame, found: DataFrame) -> DataFrame:
    return exclude(requested.select("id"), found)
