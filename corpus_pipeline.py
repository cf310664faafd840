"""A corpus pipeline: classify, apply quality rules, drop near-duplicates, cut repeats, pack.

Each stage gets all that the one before kept, as Parquet that was written and read again. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import anomalies, circulant, packing, quadratic, suffixes
from plumbline.llm.attribution import VOCABULARY
from plumbline.llm.common import fields, map_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "_mark"


def _marked(docs: DataFrame) -> DataFrame:
    """Adds MARK, a digest of the text: rows that share a doc_id are judged one by one."""
    return docs.select(*COLUMNS, F.unhex(F.sha2(F.col("text"), 256)).alias(MARK))


def _kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The marked documents that have a row in ``decisions``; repeated rows share a verdict."""
    wanted = decisions.select(F.col("doc_id").alias("_id"), F.col(MARK).alias("_kept")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col(MARK).eqNullSafe(F.col("_kept"))
    return docs.join(wanted, same, "left_semi").select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents predicted as 0 go."""
    docs = _marked(docs)
    scored = quadratic.classify(docs, table(spark, sf_dir, "labels"), (MARK,))
    return _kept(docs, scored.filter("predicted = 1"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail a base rule or are anomalous go."""
    docs = _marked(docs)
    judged = anomalies.quality_rules(docs, table(spark, sf_dir, "labels"), (MARK,))
    return _kept(docs, judged.filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest doc_id of each group stays.

    Of rows that repeat a doc_id and its text one stays, the smallest by the other columns.
    """
    docs = _marked(docs)
    kept = circulant.near_components(docs, (MARK,)).filter("kept")
    times = stored(kept.groupBy("doc_id", MARK).agg(F.count(F.lit(1)).alias("n")))
    repeated = _kept(docs, times.filter("n > 1"))
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    once = repeated.groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*")
    return _kept(docs, times.filter("n = 1")).unionByName(once)


CUT = "doc_id bigint, text string, cut boolean, blank boolean"


def _decode():
    """Whole characters of what is left of each text."""

    def run(batches):
        for batch in batches:
            kept = batch.column("kept").to_pylist()
            columns = {name: batch.column(name) for name in batch.schema.names if name != "kept"}
            yield columns | {"text": [raw.decode("utf-8", "ignore") for raw in kept]}

    return run


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated strings are cut out; documents with nothing left go.

    A cut inside a character drops the rest of that character. The other columns go through
    the operator with their row, so nothing is joined back.
    """
    rest = ("lang", "source", "n_chars")
    docs = docs.select(*COLUMNS, F.col("text").isNull().alias("blank"))
    found = suffixes.remove_repeats(docs, ("blank", *rest))
    decoded = map_batches(
        found.select("doc_id", "kept", (F.size("removed") > 0).alias("cut"), "blank", *rest),
        _decode, CUT + fields(found, rest),
    )
    text = F.when(~F.col("blank"), F.col("text"))
    size = F.when(F.col("cut"), F.length("text")).otherwise(F.col("n_chars"))
    return decoded.filter("NOT cut OR text <> ''").select(
        "doc_id", text.alias("text"), "lang", "source", size.cast("bigint").alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]
#: Models, components and packing: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
