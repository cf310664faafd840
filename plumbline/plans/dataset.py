"""The given tables as a pool of nested records with their side tables.

The tables hold documents, vectors, labels and events, and no profiles. This module
reads them as a pool, so that every operator runs on whole tables:

* a document is a record; its lines are the roles, its source is the title, its
  language the country;
* events of the user with the document's number are the record's activity;
* labels and the vector's class give the signals; labels give the gold tiers;
* the last turn of the conversation with the document's number is its cached text.

Everything is derived per row or by pre-aggregated grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import (
    DOMAINS,
    ROLES,
    FilterSettings,
    ScoreSettings,
    Settings,
    VectorSettings,
)
from plumbline.operators.ordering import last_per_key
from plumbline.operators.scored import text_features, with_activity_features
from plumbline.operators.shortlist import integrity_flags
from plumbline.operators.similarity import cosine_to
from plumbline.schema import ACTIVITY, SKILL

# Declared, so that opening a table starts no job to look for its columns.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}
KEYWORDS = {
    "terms": ("license", "token"),
    "marks": ("0", "9", "@"),
    "short": ("hering", "ouon"),
    "long": ("ment", "eaux", "und"),
}
SETTINGS = Settings(
    vector=VectorSettings(dim=64, text_chars=None),
    filter=FilterSettings(titles=("src0", "src1", "src2"), threshold=0.20),
    score=replace(
        ScoreSettings(),
        keywords=KEYWORDS,
        cosine_floor=-0.10,
        cosine_ceiling=0.30,
        snapshot_date="2024-02-01",
        recency_days=30,
        home_country="en",
        text_chars=None,
    ),
)
REFERENCE_VECTOR = 0


def record_id(number: Column) -> Column:
    """Fixed-width ids, so that id order is number order at any size."""
    return F.concat(F.lit("DOC_"), F.lpad(number.cast("string"), 12, "0"))


def _career(text: Column, source: Column, lang: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line != "")

    def role(line: Column, i: Column) -> Column:
        start = F.date_add(F.lit("2020-01-01").cast("date"), i)
        end = F.date_add(start, F.length(line) - F.lit(4))
        return F.struct(
            lang.alias("company"), source.alias("title"),
            start.cast("string").alias("start_date"),
            F.when(i > 0, end.cast("string")).alias("end_date"),
            F.floor(F.length(line) / F.lit(8)).cast("int").alias("duration_months"),
            (i == 0).alias("is_current"),
            lang.alias("industry"), source.alias("company_size"), line.alias("description"),
        )

    return F.transform(lines, role)


def activity_table(events: DataFrame) -> DataFrame:
    """One activity struct per user, from pre-aggregated events."""

    def share(kind: str) -> Column:
        hits = F.count_if(F.col("event_type") == kind)
        return hits.cast("double") / F.count(F.lit(1)).cast("double")

    def any_of(kind: str, amount: float) -> Column:
        return F.bool_or((F.col("event_type") == kind) & (F.col("value") > amount))

    purchases = F.count_if(F.col("event_type") == "purchase")
    grouped = events.groupBy("user_id").agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_active_date"),
        any_of("signup", 60.0).alias("open_to_work_flag"),
        share("click").alias("recruiter_response_rate"),
        F.max(F.get_json_object("props", "$.k").cast("int")).alias("notice_period_days"),
        any_of("view", 60.0).alias("willing_to_relocate"),
        share("view").alias("interview_completion_rate"),
        F.when(purchases < 10, -1.0).otherwise(share("purchase")).alias("offer_acceptance_rate"),
        any_of("click", 50.0).alias("verified_email"),
        any_of("error", 50.0).alias("verified_phone"),
    )
    have = set(grouped.columns)
    names = [part.split(":")[0].strip() for part in _top_level(ACTIVITY)]
    kinds = {p.split(":")[0].strip(): p.split(":", 1)[1].strip() for p in _top_level(ACTIVITY)}
    fields = [
        (F.col(n) if n in have else F.lit(None).cast(kinds[n])).alias(n) for n in names
    ]
    return grouped.select("user_id", F.struct(*fields).alias("activity"))


def _top_level(struct: str) -> list[str]:
    """The ``name: type`` parts of a struct type string, nested types kept whole."""
    parts, depth, current = [], 0, ""
    for char in struct[len("struct<") : -1]:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


def records(documents: DataFrame, career: Column | None = None) -> DataFrame:
    """(doc_id, id, profile, career_history, skills, source_order)."""
    source, lang, chars = F.col("source"), F.col("lang"), F.col("n_chars")
    years = chars.cast("double") / F.lit(120.0)
    skill = F.struct(
        source.alias("name"),
        F.when(lang == "en", " Expert ").otherwise("advanced").alias("proficiency"),
        F.lit(0).alias("endorsements"),
        F.floor(chars / F.lit(300)).cast("int").alias("duration_months"),
    ).cast(SKILL)
    profile = F.struct(
        F.lit(None).cast("string").alias("anonymized_name"),
        source.alias("headline"),
        F.concat(source, F.lit("  in "), lang).alias("summary"),
        F.lit(None).cast("string").alias("location"),
        lang.alias("country"),
        years.alias("years_of_experience"),
        F.concat(F.lit(" "), F.upper(source), F.lit(" ")).alias("current_title"),
        lang.alias("current_company"),
        F.lit(None).cast("string").alias("current_company_size"),
        F.lit(None).cast("string").alias("current_industry"),
    )
    return documents.select(
        "doc_id",
        record_id(F.col("doc_id")).alias("id"),
        profile.alias("profile"),
        (_career(F.col("text"), source, lang) if career is None else career).alias(
            "career_history"),
        F.array(skill).alias("skills"),
        F.struct(F.col("doc_id").alias("line")).alias("source_order"),
    )


def with_activity(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows keyed by doc_id with the activity struct of the user of that number."""
    activity = activity_table(events)
    joined = rows.join(activity, F.col("doc_id") == F.col("user_id"), "left")
    return joined.drop("doc_id", "user_id")


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        record_id(F.col("vec_id")).alias("id"), "embedding", F.col("label").alias("label")
    )


def signals(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Signal records of the labelled documents."""
    joined = labels.join(embeddings.select("vec_id", "label"),
                         F.col("doc_id") == F.col("vec_id"), "left")
    code = F.col("label")

    def word(vocabulary) -> Column:
        words = F.array(*[F.lit(w) for w in vocabulary])
        return F.coalesce(F.get(words, code), F.lit("unlisted"))

    flags = F.array_compact(
        F.array(
            F.when(F.col("toxic") == 1, "cv_primary"),
            F.when(F.col("quality") == 0, "stale_coding"),
            F.when(code == 9, "job_hopper"),
            F.when(code == 5, "consulting_only"),
            F.when(code == 7, "other_flag"),
        )
    )
    return joined.select(
        record_id(F.col("doc_id")).alias("id"),
        word(ROLES).alias("role_archetype"),
        word(DOMAINS).alias("domain"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.2).alias("product_vs_services"),
        F.coalesce(code / F.lit(9.0), F.lit(0.5)).alias("seniority_band_fit"),
        ((F.col("quality") == 1) & F.coalesce(code < 5, F.lit(False))).alias(
            "built_ranking_or_search"),
        F.concat(F.lit("Label "), F.coalesce(code.cast("string"), F.lit("none")),
                 F.lit(" quality "), F.col("quality").cast("string")).alias("evidence_span"),
        flags.alias("disqualifier_flags"),
    )


def gold(labels: DataFrame) -> DataFrame:
    quality, toxic = F.col("quality"), F.col("toxic")
    tier = (
        F.when((quality == 1) & (toxic == 0), 4)
        .when((quality == 1) & (toxic == 1), 2)
        .when((quality == 0) & (toxic == 0), 1)
        .otherwise(0)
    )
    return labels.select(record_id(F.col("doc_id")).alias("id"), tier.alias("tier"))


def texts(conversations: DataFrame) -> DataFrame:
    """Cached texts: the last turn of every conversation."""
    latest = last_per_key(conversations.select("conv_id", "turn", "role", "text"), "conv_id",
                          F.col("turn"))
    return latest.select(
        record_id(F.col("conv_id")).alias("id"), "text",
        F.when(F.col("role") == "assistant", "llm").otherwise("deterministic").alias("source"),
    )


@dataclass(frozen=True)
class Dataset:
    """Lazily read tables of one folder and the pool views over them."""

    spark: SparkSession
    folder: str
    settings: Settings = field(default_factory=lambda: SETTINGS)

    def table(self, name: str) -> DataFrame:
        """A table as its files are split."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """The documents as their files are split."""
        return self.table("documents")

    @property
    def pool(self) -> DataFrame:
        """Whole records: texts and activity."""
        return with_activity(records(self.documents), self.table("events"))

    @property
    def texts_pool(self) -> DataFrame:
        """Whole records without activity: one scan, no join."""
        return records(self.documents).drop("doc_id")

    @property
    def narrow(self) -> DataFrame:
        """Features, facts and integrity per record, from one scan of the texts; they are
        reduced before activity is joined."""
        rows = records(self.documents).select(
            "doc_id", "id", "source_order",
            *[c.alias(n) for n, c in text_features(self.settings).items()],
        )
        return with_activity_features(
            with_activity(rows, self.table("events")), self.settings
        )

    @property
    def vectors(self) -> DataFrame:
        return vectors(self.table("embeddings"))

    @property
    def reference(self) -> DataFrame:
        rows = self.table("embeddings").filter(F.col("vec_id") == REFERENCE_VECTOR)
        return rows.select("embedding")

    @property
    def similarity(self) -> DataFrame:
        return cosine_to(self.vectors, self.reference)

    @property
    def signals(self) -> DataFrame:
        return signals(self.table("labels"), self.table("embeddings"))

    @property
    def gold(self) -> DataFrame:
        return gold(self.table("labels"))

    @property
    def texts(self) -> DataFrame:
        return texts(self.table("conversations"))

    @property
    def flagged(self) -> DataFrame:
        return integrity_flags(self.texts_pool, self.settings.integrity)
