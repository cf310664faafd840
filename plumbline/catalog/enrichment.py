"""Batched enrichment (N*) and artifact tables (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.catalog.texts import CARD, RATES, SIGNAL_LINE
from plumbline.functions.vector import norm
from plumbline.operators import checks, enrich
from plumbline.operators.durable import durable, work_folder
from plumbline.plans.jobs import encoder_texts, profile_cards, shortlist
from plumbline.sources.tables import coverage_gaps, manifest, mirror

BATCH = 8
HEAD = enrich.rubric_summary(
    {"domains": ["search", "ranking"], "must_haves": ["shipped a ranking system"],
     "seniority_band": {"min_years": 5, "max_years": 9.5, "notes": "soft"}}
)
_CARDS = {
    "rates": RATES,
    "lined": f"SELECT *, {SIGNAL_LINE} AS line FROM rates",
    "cards": f"SELECT id, {CARD} AS card FROM lined",
    "todo": "SELECT cards.id, card, row_number() OVER (ORDER BY cards.id) - 1 AS p FROM cards "
            "WHERE id IN (SELECT id FROM matched) AND id NOT IN (SELECT id FROM signals)",
    "batched": f"SELECT id, card, (p // {BATCH})::BIGINT AS batch_id, p % {BATCH} + 1 AS n "
               "FROM todo",
}
_VIEWS = ("pool", "matched", "signals")


def _todo(data):
    return enrich.pending_entries(shortlist(data), data.signals, profile_cards(data))


@query(
    "n1_batches",
    S.using("SELECT id, batch_id, n::BIGINT AS n FROM batched", *_VIEWS, **_CARDS),
)
def batches(data):
    rows = enrich.batches(_todo(data).select("id"), BATCH)
    return rows.select("id", "batch_id", big("n").alias("n"))


_PROMPT = f"""'{HEAD.replace("'", "''")}' || chr(10) || chr(10) || 'CANDIDATES:' || chr(10) ||
  chr(10) || string_agg('[' || n || '] id: ' || id || chr(10) || trim(card), chr(10) || chr(10)
  ORDER BY n) || chr(10)"""


@query(
    "n2_prompts",
    S.using(
        f"""SELECT batch_id, length(p) AS n, md5(p) AS digest FROM (
        SELECT batch_id, {_PROMPT} AS p FROM batched GROUP BY batch_id)""",
        *_VIEWS, **_CARDS,
    ),
)
def prompts(data):
    batched = enrich.batches(_todo(data), BATCH)
    rows = enrich.prompts(batched, enrich.numbered_entry(F.col("text")), HEAD)
    return rows.select(
        "batch_id", big(F.length("prompt")).alias("n"), F.md5("prompt").alias("digest")
    )


def recorded(todo):
    """Answers made of the cards themselves; cards that mention a license have none."""
    record = F.struct(
        "id", F.lit("Data Scientist").alias("role_archetype"), F.lit("NLP/IR").alias("domain"),
        (F.length(F.trim("text")) / F.lit(10000)).cast("string").alias("product_vs_services"),
    )
    answers = todo.filter(~F.contains(F.lower("text"), F.lit("license")))
    return enrich.from_records(answers.select("id", F.to_json(record).alias("record")))


@query(
    "n3_enriched",
    S.using(
        f"""SELECT id, 'data_scientist' AS role, 'nlp_ir' AS domain,
        {S.six(S.clip('length(trim(card))::DOUBLE / 10000.0::DOUBLE'))} AS product FROM batched
        WHERE NOT contains(lower(card), 'license')""",
        *_VIEWS, **_CARDS,
    ),
)
def enriched(data):
    todo = durable(_todo(data))
    found, _ = enrich.enrich(todo, recorded(todo), HEAD, batch_size=BATCH, retries=1)
    return found.select(
        "id", F.col("role_archetype").alias("role"), "domain",
        six("product_vs_services").alias("product"),
    )


@query(
    "s20_failed_ids",
    S.using("SELECT id FROM batched WHERE contains(lower(card), 'license')", *_VIEWS, **_CARDS),
)
def failed(data):
    todo = durable(_todo(data))
    _, lost = enrich.enrich(todo, recorded(todo), HEAD, batch_size=BATCH, retries=0)
    return lost.orderBy("id")


@query(
    "n4_first_pending",
    S.using("SELECT id FROM todo ORDER BY id LIMIT 20", *_VIEWS, **_CARDS),
)
def first_pending(data):
    """An incremental run of limited size: the first pending ids only."""
    rows = enrich.pending_entries(shortlist(data), data.signals, profile_cards(data), 20)
    return rows.select("id")


@query(
    "n5_encoded",
    S.using(
        """SELECT id, 64::BIGINT AS n, '1.000000' AS length FROM docs
        WHERE id NOT IN (SELECT id FROM vecs)""",
        "docs", "vecs",
    ),
)
def encoded(data):
    """Vectors for the records that have none yet, committed chunk by chunk."""
    folder = work_folder(data.spark, "vectors")
    texts = encoder_texts(data, "doc_id")
    done = data.table("embeddings").select(F.col("vec_id").alias("doc_id"))
    enrich.encode_chunks(texts, done, enrich.hashed_words(64), folder, "doc_id")
    rows = enrich.read_chunks(data.spark, folder, "doc_id")
    return rows.select("id", big(F.size("embedding")).alias("n"),
                       six(norm(F.col("embedding"))).alias("length"))


@query(
    "n5_pending_ranges",
    """WITH flagged AS (SELECT doc_id, text, doc_id IN (SELECT vec_id FROM embeddings
        WHERE label <> 3) AS done FROM documents),
      placed AS (SELECT doc_id, done, row_number() OVER (ORDER BY doc_id) - row_number() OVER
        (PARTITION BY done ORDER BY doc_id) AS run FROM flagged)
    SELECT min(doc_id) AS low, max(doc_id) AS high, count(*) AS rows, 0::BIGINT AS gaps
    FROM placed WHERE NOT done GROUP BY run""",
)
def pending_ranges(data):
    """What is left to encode when the vectors of one class are missing."""
    done = data.table("embeddings").filter("label <> 3").select(F.col("vec_id").alias("doc_id"))
    return enrich.pending_ranges(
        data.documents, done, "doc_id", most=1 << 30).select(
        "low", "high", "rows", big("gaps").alias("gaps"))


# --- artifact tables -----------------------------------------------------------


@query(
    "s3_vectors",
    S.using(
        f"""SELECT id, len(e) AS n, {S.six('sqrt(list_inner_product(e, e))')} AS length
        FROM vecs""",
        "vecs",
    ),
)
def vectors(data):
    return data.vectors.select(
        "id", big(F.size("embedding")).alias("n"), six(norm(F.col("embedding"))).alias("length")
    )


@query(
    "s4_vector_checks",
    S.using(
        """SELECT 'vector_missing' AS "check", count(*) AS n FROM docs
        WHERE id NOT IN (SELECT id FROM vecs) HAVING count(*) > 0""",
        "docs", "vecs",
    ),
)
def vector_checks(data):
    """What would stop the vectors of the whole pool from being written."""
    wanted = data.texts_pool.select("id").join(
        data.vectors.select("id", "embedding"), "id", "left")
    found = checks.vector_violations(wanted, data.settings.vector.dim)
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s5_manifest",
    f"""SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
      {S.six('min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))')}
      AS min_norm,
      {S.six('max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))')}
      AS max_norm FROM embeddings""",
)
def vector_manifest(data):
    row = manifest(data.vectors, data.settings.vector, "embeddings")
    return row.select(
        "n", big("min_dim").alias("min_dim"), big("max_dim").alias("max_dim"),
        six("min_norm").alias("min_norm"), six("max_norm").alias("max_norm"),
    )


@query("s6_sorted_ids", S.using("SELECT id FROM matched ORDER BY id", "matched"))
def sorted_ids(data):
    return shortlist(data).select("id").orderBy("id")


@query(
    "s8_flags",
    S.using("SELECT id, array_to_string(reasons, '|') AS reasons FROM flagged ORDER BY id",
            "flagged"),
)
def flag_file(data):
    return data.flagged.orderBy("id").select("id", joined("reasons").alias("reasons"))


@query(
    "s14_dimension_guard",
    """SELECT count(*) AS n, sum((len(embedding) <> (SELECT len(embedding) FROM embeddings
      WHERE vec_id = 0))::BIGINT)::BIGINT AS mismatched FROM embeddings""",
)
def dimension_guard(data):
    return checks.dimension_mismatches(data.vectors, data.reference)


@query(
    "s21_mirror_coverage",
    S.using(
        " UNION ALL ".join(
            f"SELECT '{n}' AS artifact, count(*) AS found, (SELECT count(*) FROM matched) - "
            f"count(*) AS missing FROM matched WHERE id IN (SELECT id FROM {v})"
            for n, v in (("pool", "docs"), ("vectors", "vecs"), ("signals", "signals"),
                         ("flags", "flagged"), ("texts", "texts"))
        ),
        "matched", "docs", "vecs", "signals", "flagged", "texts",
    ),
)
def mirror_coverage(data):
    tables = {
        "pool": data.texts_pool, "vectors": data.vectors, "signals": data.signals,
        "flags": data.flagged, "texts": data.texts,
    }
    return coverage_gaps(tables, shortlist(data))


@query(
    "s21_mirror_vectors",
    S.using("SELECT id, label::BIGINT AS label FROM vecs WHERE id IN (SELECT id FROM matched)",
            "vecs", "matched"),
)
def mirrored(data):
    tables = mirror({"vectors": data.vectors}, shortlist(data))
    return tables["vectors"].select("id", big("label").alias("label"))


