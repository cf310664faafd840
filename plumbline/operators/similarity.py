"""Cosine scans against one or many unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import is_target_title
from plumbline.functions.vector import dot, l2_normalize
from plumbline.operators.ordering import top_n, top_per_group

# Query vectors handled in one pass; a larger set is scored in several passes.
QUERIES_PER_PASS = 256


def cosine_to(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, cosine) of every vector against the one vector of ``reference``.

    The reference row reaches the tasks as a scalar subquery, which Spark also
    rejects when it has more than one row; there is no join.
    """
    probe = reference.select(F.col("embedding").alias("_probe")).scalar()
    with_probe = vectors.withColumn("_probe", probe)
    return with_probe.select("id", dot(F.col("embedding"), F.col("_probe")).alias("cosine"))


def similar_top(vectors: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    scored = cosine_to(vectors, reference)
    return top_n(scored, [F.col("cosine").desc(), F.col("id").asc()], k)


def score_queries(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, cosine) for every vector and every query vector.

    The queries of one pass travel as one array, so the vectors are read once per
    pass and every row is expanded where it is; nothing is joined or shuffled.
    """
    passes = -(-queries.count() // QUERIES_PER_PASS)
    scored = None
    for number in range(passes):
        part = queries if passes == 1 else queries.filter(
            F.pmod(F.xxhash64("query"), F.lit(passes)) == number
        )
        packed = part.agg(F.collect_list(F.struct("query", "embedding"))).scalar()
        rows = (
            vectors.withColumn("_probes", packed)
            .select("id", "embedding", F.explode("_probes").alias("_probe"))
            .select(
                F.col("_probe.query").alias("query"), "id",
                dot(F.col("embedding"), F.col("_probe.embedding")).alias("cosine"),
            )
        )
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        return vectors.select(F.lit(None).cast("int").alias("query"), "id",
                              F.lit(0.0).alias("cosine")).limit(0)
    return scored


def similar_top_per_query(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    order = [F.col("cosine").desc(), F.col("id").asc()]
    return top_per_group(score_queries(vectors, queries), ["query"], order, k)


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Unit mean vector per label as (query, embedding); sums are pre-aggregated per task."""
    cells = vectors.select(F.col(label).alias("query"), F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("query", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One entry per vector dimension.
    packed = means.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return packed.select("query", l2_normalize(F.col("c.v")).alias("embedding"))


def similarity_report(
    pool: DataFrame, vectors: DataFrame, reference: DataFrame, titles, k: int
) -> DataFrame:
    """The k most similar ids with the title of their record and whether it is a target."""
    top = similar_top(vectors, reference, k)
    found = pool.select("id", F.col("profile.current_title").alias("_title"))
    found = found.join(top.select("id"), "id", "left_semi").withColumn("_in_pool", F.lit(True))
    shown = F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.lit("(no title)"))
    return top.join(found, "id", "left").select(
        "rank", "id", "cosine",
        F.when(F.col("_in_pool"), shown).otherwise("?").alias("title"),
        F.coalesce(is_target_title(F.col("_title"), titles), F.lit(False)).alias("is_target"),
    )
