"""Joins and set membership on record ids.

No side is broadcast by hint: ids sets grow with the data, and the size of a side
is known to Spark at run time (adaptive execution turns a join into a broadcast
join when a finished side is below ``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import MISSING_SIMILARITY
from plumbline.functions.scalar import squeeze


def with_similarity(pool: DataFrame, similarity: DataFrame) -> DataFrame:
    """Attach ``cosine``; a record without a vector gets a value below any cosine."""
    joined = pool.join(similarity.select("id", "cosine"), "id", "left")
    return joined.withColumn(
        "has_vector", F.col("cosine").isNotNull()
    ).withColumn("cosine", F.coalesce("cosine", F.lit(MISSING_SIMILARITY)))


def with_signals(pool: DataFrame, signals: DataFrame) -> DataFrame:
    """Attach the signal record as one struct, null where there is none."""
    fields = [F.col(name) for name in signals.columns if name != "id"]
    packed = signals.select("id", F.struct(*fields).alias("signal"))
    return pool.join(packed, "id", "left")


def with_membership(pool: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Boolean column: is the id in the other table."""
    marks = ids.select("id").distinct().withColumn("_mark", F.lit(True))
    joined = pool.join(marks, "id", "left")
    return joined.withColumn(name, F.col("_mark").isNotNull()).drop("_mark")


def restrict(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def exclude(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def pending(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested ids that are not done; ordered by whoever writes or batches them."""
    return exclude(requested.select("id").distinct(), done)


def with_text(top: DataFrame, texts: DataFrame, fallback) -> DataFrame:
    """Cached text of the ranked rows where it is not empty, else the computed one.

    ``top`` is a cut of at most a report's size and drives the join.
    """
    cached = texts.select("id", squeeze(F.col("text")).alias("_cached"))
    # Spark knows the size of a limit, so it broadcasts the cut by itself.
    wanted = restrict(cached, top)
    joined = top.join(wanted, "id", "left")
    found = F.nullif(F.col("_cached"), F.lit(""))
    return (
        joined.withColumn("text_source", F.when(found.isNotNull(), "cached").otherwise("computed"))
        .withColumn("reasoning", F.coalesce(found, fallback))
        .drop("_cached")
    )


def bind_expected(returned: DataFrame, expected: DataFrame) -> DataFrame:
    """Keep returned records whose id was asked for in the same batch.

    ``expected`` has (batch_id, id), ``returned`` has (batch_id, seq, id, ...). A batch
    that asked for one id and got one record binds that record to the id it asked
    for. The last record of an id wins.
    """
    asked = expected.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_asked"), F.min("id").alias("_only")
    )
    got = returned.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_got"))
    single = asked.join(got, "batch_id").filter("_asked = 1 AND _got = 1")
    bound = returned.join(single.select("batch_id", "_only"), "batch_id", "left")
    bound = bound.withColumn("id", F.coalesce("_only", "id")).drop("_only")
    return bound.join(expected.select("batch_id", "id"), ["batch_id", "id"], "left_semi")


def aligned(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts that must agree before ids and vectors may be zipped."""
    left = ids.agg(F.count(F.lit(1)).alias("n_ids"), F.count("id").alias("n_keyed"))
    right = vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count("embedding").alias("n_filled")
    )
    matched = restrict(ids, vectors).agg(F.count(F.lit(1)).alias("n_matched"))
    # Three one-row tables.
    row = left.select(
        "n_ids", "n_keyed",
        right.select("n_vectors").scalar().alias("n_vectors"),
        right.select("n_filled").scalar().alias("n_filled"),
        matched.scalar().alias("n_matched"),
    )
    same = (
        (F.col("n_ids") == F.col("n_vectors"))
        & (F.col("n_ids") == F.col("n_matched"))
        & (F.col("n_keyed") == F.col("n_ids"))
        & (F.col("n_filled") == F.col("n_vectors"))
    )
    return row.withColumn("aligned", same)
