"""Vector operators (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, query, six
from plumbline.functions.vector import l2_normalize, narrow, norm
from plumbline.operators import similarity as sim
from plumbline.operators.membership import with_similarity

# Unit mean vector of every class: one query per class, from the whole table.
CENTROIDS = """
SELECT label AS query, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS q FROM (
  SELECT label, list(v ORDER BY i) AS c FROM (
    SELECT label, i, avg(v) AS v FROM (
      SELECT label, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM vecs)
    GROUP BY label, i) GROUP BY label)"""
QUERY_SCORES = """
SELECT query, id, label, list_inner_product(e, q) AS cosine FROM vecs, centroids"""


@query("v1_cosine", S.using(f"SELECT id, {S.six('cosine')} AS cosine FROM sims", "sims"))
def cosines(data):
    return data.similarity.select("id", six("cosine").alias("cosine"))


@query(
    "v2_top_k",
    S.using(
        f"""SELECT id, {S.six('cosine')} AS cosine, row_number() OVER (ORDER BY cosine DESC, id)
        AS rank FROM sims ORDER BY cosine DESC, id LIMIT 50""",
        "sims",
    ),
)
def top_k(data):
    top = sim.similar_top(data.vectors, data.reference, 50)
    return top.select("id", six("cosine").alias("cosine"), "rank")


@query(
    "v2_top_k_per_query",
    S.using(
        f"""SELECT query::BIGINT AS query, id, {S.six('cosine')} AS cosine, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank
        FROM scores) WHERE rank <= 10""",
        "vecs", centroids=CENTROIDS, scores=QUERY_SCORES,
    ),
)
def top_k_per_query(data):
    queries = sim.centroids(data.vectors, "label")
    top = sim.similar_top_per_query(data.vectors, queries, 10)
    return top.select(big("query").alias("query"), "id", six("cosine").alias("cosine"), "rank")


_SCALED = """SELECT id, list_transform(e, lambda x: x * (label + 1)::DOUBLE) AS v FROM vecs"""


@query(
    "v3_l2_normalize",
    S.using(
        f"""SELECT id, {S.six('n')} AS before, {S.six('sqrt(list_inner_product(u, u))')} AS after,
        {S.six('list_max(u)')} AS largest, {S.six('list_min(u)')} AS smallest FROM (
        SELECT id, n, list_transform(v, lambda x: x / n) AS u FROM (
        SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM scaled))""",
        "vecs", scaled=_SCALED,
    ),
)
def normalized(data):
    factor = (F.col("label") + 1).cast("double")
    scaled = data.vectors.withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * factor)
    )
    unit = scaled.withColumn("u", l2_normalize(F.col("v")))
    return unit.select(
        "id", six(norm(F.col("v"))).alias("before"), six(norm(F.col("u"))).alias("after"),
        six(F.array_max("u")).alias("largest"), six(F.array_min("u")).alias("smallest"),
    )


@query(
    "v4_narrow",
    S.using(
        f"""SELECT id, len(v) AS n, {S.six('list_max(v)::DOUBLE')} AS largest,
        {S.six('list_inner_product(v::DOUBLE[], v::DOUBLE[])')} AS energy FROM (
        SELECT id, list_transform(e, lambda x: (x / 3.0::DOUBLE)::FLOAT) AS v FROM vecs)""",
        "vecs",
    ),
)
def narrowed(data):
    thirds = F.transform("embedding", lambda x: x.cast("double") / 3.0)
    rows = data.vectors.withColumn("v", narrow(thirds))
    squared = F.aggregate(
        "v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")
    )
    return rows.select(
        "id", big(F.size("v")).alias("n"), six(F.array_max("v").cast("double")).alias("largest"),
        six(squared).alias("energy"),
    )


@query(
    "v5_missing_vectors",
    S.using(
        f"""SELECT count(*) AS records, sum((NOT has_vector)::BIGINT)::BIGINT AS missing,
        {S.six('min(cosine)')} AS lowest FROM joined""",
        "joined",
    ),
)
def missing_vectors(data):
    matched = with_similarity(data.pool.select("id"), data.similarity)
    return matched.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("has_vector")).alias("missing"),
        six(F.min("cosine")).alias("lowest"),
    )


@query(
    "v6_similarity_report",
    S.using(
        f"""SELECT rank, s.id, {S.six('s.cosine')} AS cosine, coalesce(title, '?') AS title,
        coalesce(is_target, false) AS is_target FROM (SELECT id, cosine,
        row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM sims) s
        LEFT JOIN rec ON rec.id = s.id WHERE rank <= 50""",
        "sims", "rec",
    ),
)
def report(data):
    shown = sim.similarity_report(
        data.pool, data.vectors, data.reference, data.settings.filter.titles, 50
    )
    return shown.select("rank", "id", six("cosine").alias("cosine"), "title", "is_target")
