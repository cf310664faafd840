"""Explanation texts: facts, fallback, acceptance and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import GAP_CUES, TERMS, TextSettings
from plumbline.functions.grounding import (
    clean_title,
    closed_world,
    fact_card,
    fallback_text,
    final_text,
    gap_notes,
    known_numbers,
    known_terms,
    leading_terms,
    text_issues,
)
from plumbline.functions.scalar import strip
from plumbline.functions.text import mentions_gap
from plumbline.operators.durable import durable
from plumbline.operators.membership import restrict
from plumbline.operators.neardup import similar_pairs
from plumbline.operators.textindex import TextIndex


def with_fallback(top: DataFrame, settings: TextSettings) -> DataFrame:
    """Ranked rows with their gaps and the text made of their own facts."""
    signal = F.col("signal")
    gaps = gap_notes(
        F.col("flags"), F.col("notice_days"), F.col("availability"), F.col("is_open"), settings
    )
    text = fallback_text(
        F.col("rank"), clean_title(F.col("title")), F.col("years"), signal["role_archetype"],
        F.coalesce(signal["built_ranking_or_search"], F.lit(False)), F.col("gaps"),
    )
    return top.withColumn("gaps", gaps).withColumn("fallback", final_text(text))


def facts(top: DataFrame, pool: DataFrame, settings: TextSettings) -> DataFrame:
    """One fact row per ranked row, with the words and numbers a text may use."""
    signal = F.col("signal")
    # The wide record is fetched for the ranked rows only.
    records = restrict(pool.select("id", "profile", "career_history"), top)
    joined = with_fallback(top, settings).join(records, "id", "left")
    evidence = F.coalesce(signal["evidence_span"], F.lit(""))
    corpus = closed_world(F.col("profile"), F.col("career_history"), evidence)
    parts = {t: F.col("contributions")[t] for t in TERMS}
    known = F.col("corpus")
    return joined.withColumn("corpus", corpus).select(
        "rank", "id",
        clean_title(F.col("title")).alias("title"), "years",
        strip(F.col("country")).alias("country"),
        F.coalesce(signal["role_archetype"], F.lit("")).alias("role"),
        F.coalesce(signal["domain"], F.lit("")).alias("domain"),
        F.coalesce(signal["built_ranking_or_search"], F.lit(False)).alias("built"),
        F.coalesce(signal["product_vs_services"], F.lit(0.5)).alias("product_ratio"),
        F.coalesce(signal["seniority_band_fit"], F.lit(0.5)).alias("seniority_fit"),
        evidence.alias("evidence"), "flags", "final", "base_fit", "availability",
        leading_terms(parts, settings.leading_terms).alias("leading"),
        "notice_days", "last_active", "is_open", "relocates", "gaps", "fallback",
        known_terms(known).alias("terms"),
        known_numbers(known, F.col("years"), F.col("notice_days"),
                      F.col("career_history")).alias("numbers"),
    )


def check_texts(texts: DataFrame, fact_rows: DataFrame, settings: TextSettings) -> DataFrame:
    """Texts (id, text, ...) with the issues found against the facts of their record."""
    closed = fact_rows.select("id", "terms", "numbers")
    joined = texts.join(closed, "id")
    issues = text_issues(F.col("text"), F.col("terms"), F.col("numbers"), settings)
    return joined.withColumn("issues", issues).drop("terms", "numbers")


def prompt_entries(fact_rows: DataFrame, settings: TextSettings) -> DataFrame:
    row = {name: F.col(name) for name in fact_rows.columns}
    return fact_rows.select("id", "rank", fact_card(row, settings).alias("text"))


def accept_texts(
    fact_rows: DataFrame,
    generated: DataFrame,
    retried: DataFrame,
    accepted: TextIndex,
    settings: TextSettings,
) -> DataFrame:
    """(id, rank, text, source, attempt): first text, else its retry, else the fallback.

    Rows are decided in rank order: a text is taken when it passes the checks and is
    not similar to any text decided before it (nor to an earlier accepted one). That
    order is followed exactly; earlier accepted texts are looked up in their index, and the new
    ones are compared with one another, in rounds instead of row by row: a version is
    dropped as soon as a similar earlier version is taken, and taken as soon as all
    similar earlier versions are dropped. Input is a top-n, so a round is small; the
    number of rounds is the longest chain of similar texts.
    """
    ranks = fact_rows.select("id", "rank")

    def version(texts: DataFrame, number: int) -> DataFrame:
        checked = check_texts(texts.select("id", "text"), fact_rows, settings)
        return checked.join(ranks, "id").select(
            "id", "rank", F.lit(number).alias("version"), "text",
            (F.size("issues") == 0).alias("valid"),
        )

    last = fact_rows.select(
        "id", "rank", F.lit(2).alias("version"), F.col("fallback").alias("text"),
        F.lit(True).alias("valid"),
    )
    versions = version(generated, 0).unionByName(version(retried, 1)).unionByName(last)
    node = F.concat_ws("|", F.col("version").cast("string"), "id")
    valid = durable(versions.filter("valid").withColumn("node", node))
    texts = valid.select(F.col("node").alias("id"), "text")
    asked = texts.join(valid.filter("version < 2").select(F.col("node").alias("id")), "id")
    stale = accepted.similar_to(asked).select(F.col("id").alias("node")).distinct()
    nodes = durable(valid.join(stale, "node", "left_anti"))
    pairs = similar_pairs(nodes.select(F.col("node").alias("id"), "text"), settings.similar_at)
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    mine = nodes.select(F.col("node"), F.col("rank"), F.col("version"))
    theirs = mine.select(F.col("node").alias("other"), F.col("rank").alias("other_rank"))
    edges = durable(
        both.withColumnRenamed("id", "node").join(mine, "node").join(theirs, "other")
        .filter((F.col("other_rank") < F.col("rank")) & F.col("version").between(0, 1))
        .select("node", "other")
    )
    # A later version of a record waits for its earlier versions.
    state = nodes.withColumn("taken", F.lit(None).cast("boolean"))
    while True:
        state = durable(_decide(state, edges))
        if state.filter("taken IS NULL").isEmpty():
            break
    chosen = state.filter("taken")
    return chosen.select(
        "id", "rank", "text",
        F.when(F.col("version") == 2, "deterministic").otherwise("llm").alias("source"),
        F.element_at(F.array(F.lit("generated"), F.lit("regenerated"), F.lit("fallback")),
                     F.col("version") + 1).alias("attempt"),
    )


def _decide(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: settle every version whose earlier neighbours are settled."""
    known = state.select(F.col("node").alias("other"), F.col("taken").alias("other_taken"))
    blocked = edges.join(known, "other").groupBy("node").agg(
        F.coalesce(F.bool_or("other_taken"), F.lit(False)).alias("hit"),
        F.count_if(F.col("other_taken").isNull()).alias("waiting"),
    )
    siblings = state.select("id", F.col("version").alias("v"), F.col("taken").alias("t"))
    own = (
        state.select("node", "id", "version")
        .join(siblings, "id")
        .filter((F.col("v") >= 0) & (F.col("v") < F.col("version")))
        .groupBy("node")
        .agg(
            F.coalesce(F.bool_or("t"), F.lit(False)).alias("done"),
            F.count_if(F.col("t").isNull()).alias("undecided"),
        )
    )
    joined = state.join(blocked, "node", "left").join(own, "node", "left")
    hit = F.coalesce("hit", F.lit(False)) | F.coalesce("done", F.lit(False))
    free = (F.coalesce("waiting", F.lit(0)) == 0) & (F.coalesce("undecided", F.lit(0)) == 0)
    taken = (
        F.when(F.col("taken").isNotNull(), F.col("taken"))
        .when(hit, False)
        .when(free, True)
    )
    return joined.withColumn("taken", taken).select(*state.columns)


def quality_rows(fact_rows: DataFrame, texts: DataFrame, settings: TextSettings) -> DataFrame:
    """Facts with their text (null if missing), its issues and whether it names a gap."""
    checked = check_texts(texts, fact_rows, settings)
    columns = ["id", "text", "source", "issues"]
    joined = fact_rows.join(checked.select(*columns), "id", "left")
    return joined.withColumn("mentions_gap", mentions_gap(F.col("text"), GAP_CUES))
