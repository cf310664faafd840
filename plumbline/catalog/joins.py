"""Joins and set membership (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, query, six
from plumbline.catalog.texts import fingerprint_sql
from plumbline.operators import membership as mb
from plumbline.operators import metrics, sweep
from plumbline.operators.neardup import near_duplicates
from plumbline.operators.sampling import outside_flagged
from plumbline.operators.summary import lost_ids
from plumbline.plans.dataset import record_id
from plumbline.plans.jobs import full_ranking, ranked_output, shortlist, sweep_features


@query(
    "j1_pool_similarity",
    S.using(f"SELECT id, {S.six('cosine')} AS cosine, has_vector FROM joined", "joined"),
)
def pool_similarity(data):
    matched = mb.with_similarity(data.pool.select("id"), data.similarity)
    return matched.select("id", six("cosine").alias("cosine"), "has_vector")


@query(
    "j2_pool_signals",
    S.using(
        """SELECT docs.id, s.id IS NOT NULL AS known, s.role AS role FROM docs
        LEFT JOIN signals s ON s.id = docs.id""",
        "docs", "signals",
    ),
)
def pool_signals(data):
    matched = mb.with_signals(data.pool.select("id"), data.signals)
    return matched.select(
        "id", F.col("signal").isNotNull().alias("known"),
        F.col("signal.role_archetype").alias("role"),
    )


@query(
    "j3_flag_membership",
    S.using(
        """SELECT docs.id, f.id IS NOT NULL AS impossible FROM docs
        LEFT JOIN flagged f ON f.id = docs.id""",
        "docs", "flagged",
    ),
)
def flag_membership(data):
    return mb.with_membership(data.pool.select("id"), data.flagged, "impossible")


@query(
    "j4_cached_text",
    S.using(
        f"""SELECT r.id, CASE WHEN coalesce({S.sq('t.text')}, '') <> '' THEN 'cached' ELSE
        'computed' END AS text_source FROM ranked r LEFT JOIN texts t ON t.id = r.id
        WHERE rank <= 100""",
        "ranked", "texts",
    ),
)
def cached_text(data):
    return ranked_output(data).select("id", "text_source")


@query(
    "j5_restrict",
    S.using("SELECT docs.id, lang FROM docs WHERE id IN (SELECT id FROM matched)",
            "docs", "matched"),
)
def restricted(data):
    rows = data.pool.select("id", F.col("profile.country").alias("lang"))
    return mb.restrict(rows, shortlist(data))


@query(
    "j6_pending",
    S.using("SELECT id FROM matched WHERE id NOT IN (SELECT id FROM signals)",
            "matched", "signals"),
)
def pending(data):
    return mb.pending(shortlist(data), data.signals).orderBy("id")


@query(
    "j7_not_in_pool",
    S.using(
        f"""SELECT id FROM (SELECT DISTINCT {S.number('o_custkey')} AS id FROM orders)
        WHERE id NOT IN (SELECT id FROM pool)""",
        "pool",
    ),
)
def not_found(data):
    """The customers of the orders as requested ids."""
    requested = data.table("orders").select(record_id(F.col("o_custkey")).alias("id"))
    return lost_ids(requested.distinct(), data.texts_pool.select("id"))


@query("j8_judged", S.using("SELECT id, rank, tier::BIGINT AS tier FROM judged", "judged"))
def judged(data):
    rows = metrics.judge(full_ranking(data), data.gold)
    return rows.select("id", "rank", big("tier").alias("tier"))


@query(
    "j9_gold_missing",
    S.using(
        """SELECT id, tier::BIGINT AS tier, tier >= 3 AS relevant FROM gold
        WHERE id NOT IN (SELECT id FROM scored)""",
        "gold", "scored",
    ),
)
def gold_missing(data):
    rows = metrics.missing_from(shortlist(data), data.gold, data.settings.metric)
    return rows.select("id", big("tier").alias("tier"), "relevant")


@query(
    "j10_flagged_in_shortlist",
    S.using("SELECT id FROM flagged WHERE id IN (SELECT id FROM matched)", "flagged", "matched"),
)
def flagged_in_shortlist(data):
    return mb.restrict(data.flagged, shortlist(data)).select("id")


@query(
    "j10_flagged_outside",
    S.using(
        """SELECT id FROM flagged WHERE id NOT IN (SELECT id FROM matched) ORDER BY id LIMIT 5""",
        "flagged", "matched",
    ),
)
def flagged_outside(data):
    return outside_flagged(data.flagged, shortlist(data), 5).select("id")


@query(
    "j11_aligned",
    S.using(
        """SELECT *, n_ids = n_vectors AND n_ids = n_matched AND n_keyed = n_ids
          AND n_filled = n_vectors AS aligned
        FROM (SELECT (SELECT count(*) FROM pool) AS n_ids, (SELECT count(id) FROM pool) AS n_keyed,
        (SELECT count(*) FROM embeddings) AS n_vectors,
        (SELECT count(embedding) FROM embeddings) AS n_filled,
        (SELECT count(*) FROM pool WHERE id IN (SELECT id FROM vecs)) AS n_matched)""",
        "pool", "vecs",
    ),
)
def aligned(data):
    return mb.aligned(data.texts_pool.select("id"), data.vectors)


@query(
    "j12_bind_expected",
    """WITH expected AS (SELECT DISTINCT conv_id AS batch, conv_id::VARCHAR AS id
        FROM conversations UNION SELECT DISTINCT conv_id, (conv_id + 1)::VARCHAR
        FROM conversations WHERE role = 'system'),
      returned AS (SELECT conv_id AS batch, turn, (conv_id + (role = 'user')::INT)::VARCHAR AS id,
        text FROM conversations WHERE role <> 'system'),
      asked AS (SELECT batch, count(*) AS n, min(id) AS only FROM expected GROUP BY batch),
      got AS (SELECT batch, count(*) AS n FROM returned GROUP BY batch),
      bound AS (SELECT r.batch, turn, text, CASE WHEN a.n = 1 AND g.n = 1 THEN a.only ELSE r.id
        END AS id FROM returned r JOIN asked a ON a.batch = r.batch
        JOIN got g ON g.batch = r.batch)
    SELECT batch AS batch_id, bound.id, max(turn)::BIGINT AS seq FROM bound
    JOIN expected USING (batch, id) GROUP BY ALL""",
)
def bound(data):
    turns = data.table("conversations")
    own = turns.select(F.col("conv_id").alias("batch_id"), F.col("conv_id").cast("string").alias(
        "id"))
    more = turns.filter("role = 'system'").select(
        F.col("conv_id").alias("batch_id"), (F.col("conv_id") + 1).cast("string").alias("id")
    )
    expected = own.unionByName(more).distinct()
    returned = turns.filter("role <> 'system'").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("seq"),
        (F.col("conv_id") + (F.col("role") == "user").cast("int")).cast("string").alias("id"),
    )
    kept = mb.bind_expected(returned, expected)
    return kept.groupBy("batch_id", "id").agg(F.max("seq").alias("seq"))


def _finals(floor: float) -> str:
    available = f"({S.d(floor)} + ({S.d(1)} - {S.d(floor)}) * blend)"
    return (
        f"CASE WHEN impossible THEN {S.d(0)} ELSE greatest({S.d(0)}, base_fit - penalties) * "
        f"{available} * location END"
    )


@query(
    "j13_grid",
    S.using(
        " UNION ALL ".join(
            f"""SELECT {i}::BIGINT AS config_id, count(*) AS n, {S.six(f'max({_finals(f)})')}
            AS best, {S.six(f'min({_finals(f)})')} AS worst FROM scored"""
            for i, f in enumerate((0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80))
        ),
        "scored",
    ),
)
def grid(data):
    rescored = sweep.rescore(sweep_features(data), sweep.floor_grid(data.settings.score))
    summed = rescored.groupBy(big("config_id").alias("config_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("final").alias("b"), F.min("final").alias("w")
    )
    return summed.select("config_id", "n", six("b").alias("best"), six("w").alias("worst"))


@query(
    "j14_near_duplicate",
    f"""WITH f AS (SELECT doc_id, {fingerprint_sql('text')} AS fp FROM documents),
      s AS (SELECT doc_id, CASE WHEN fp = '' THEN []::VARCHAR[] ELSE
        list_distinct(string_split(fp, ' ')) END AS w FROM f),
      p AS (SELECT a.doc_id AS late, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na,
        len(b.w) AS nb FROM s a JOIN s b ON b.doc_id < a.doc_id
        AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) - 0.001
        AND len(a.w) > 0 AND len(b.w) > 0),
      hit AS (SELECT DISTINCT late FROM p
        WHERE shared::DOUBLE / (na + nb - shared)::DOUBLE >= 0.85::DOUBLE)
    SELECT {S.number('doc_id')} AS id, doc_id IN (SELECT late FROM hit) AS is_duplicate
    FROM documents""",
)
def near_duplicate(data):
    documents = data.documents.select(
        record_id(F.col("doc_id")).alias("id"), "doc_id", "text"
    )
    return near_duplicates(documents, "doc_id", data.settings.text.similar_at)
