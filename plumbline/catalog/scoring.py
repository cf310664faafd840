"""Features, scores and the ranked output (F*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.config import FLAG_PHRASES, ROLE_PHRASES, TERMS
from plumbline.functions.scoring import availability_parts
from plumbline.operators import scored as sco
from plumbline.operators.explain import with_fallback
from plumbline.operators.membership import with_text
from plumbline.operators.ordering import positions
from plumbline.operators.summary import true_rate
from plumbline.plans.jobs import full_ranking, ranked_output, ranked_top, scored_pool

FEATURES = (*TERMS, "availability", "location")


@query(
    "f1_features",
    S.using(
        f"""SELECT id, {', '.join(f'{S.six(t)} AS {t}' for t in FEATURES)},
        array_to_string(flags, '|') AS flags, impossible FROM feats""",
        "feats",
    ),
)
def features(data):
    rows = scored_pool(data)
    return rows.select(
        "id", *[six(t).alias(t) for t in FEATURES], joined("flags").alias("flags"), "impossible"
    )


@query(
    "f2_without_signals",
    S.using(
        f"""SELECT id, {S.six('role_match')} AS role_match, {S.six('domain_match')}
        AS domain_match, {S.six('product_ratio')} AS product_ratio, {S.six('seniority_fit')}
        AS seniority_fit, {S.six('built_ranking')} AS built_ranking, len(flags) AS n_flags
        FROM feats WHERE NOT known""",
        "feats",
    ),
)
def without_signals(data):
    rows = scored_pool(data).filter(F.col("signal").isNull())
    names = ("role_match", "domain_match", "product_ratio", "seniority_fit", "built_ranking")
    return rows.select("id", *[six(n).alias(n) for n in names],
                       big(F.size("flags")).alias("n_flags"))


@query(
    "f3_availability_parts",
    S.using(
        "SELECT id, "
        + ", ".join(f"{S.six(e)} AS {n}" for n, e in S.BLEND_PARTS.items())
        + " FROM pool",
        "pool",
    ),
)
def parts(data):
    columns = availability_parts(F.col("activity"), data.settings.score)
    return data.pool.select("id", *[six(c).alias(n) for n, c in columns.items()])


@query(
    "f4_availability",
    S.using(
        f"""SELECT id, {S.six('blend')} AS blend, {S.six(S.AVAILABILITY)} AS availability
        FROM rec""",
        "rec",
    ),
)
def availability(data):
    floor = data.settings.score.availability_floor
    rows = data.narrow.withColumn(
        "availability", sco.availability_from_blend(F.col("blend"), floor)
    )
    return rows.select("id", six("blend").alias("blend"), six("availability").alias(
        "availability"))


@query(
    "k1_base_fit",
    S.using(f"SELECT id, {S.six('base_fit')} AS base_fit FROM scored", "scored"),
)
def base_fit(data):
    return scored_pool(data).select("id", six("base_fit").alias("base_fit"))


@query(
    "k2_penalties",
    S.using(
        f"""SELECT id, {S.six('penalties')} AS penalties, array_to_string(list_transform(flags,
        lambda f: f || '=' || {S.six(S.PENALTY)}), '|') AS detail FROM scored""",
        "scored",
    ),
)
def penalties(data):
    shown = F.transform(
        F.map_entries("penalty_detail"),
        lambda e: F.concat(e["key"], F.lit("="), six(e["value"])),
    )
    return scored_pool(data).select(
        "id", six("penalties").alias("penalties"), joined(shown).alias("detail")
    )


@query(
    "k3_final_score",
    S.using(f"SELECT id, {S.six('final')} AS final, impossible FROM scored", "scored"),
)
def final_scores(data):
    return scored_pool(data).select("id", six("final").alias("final"), "impossible")


@query(
    "k4_breakdown",
    S.using(
        f"""SELECT id, {S.six('final')} AS final, {S.six('base_fit')} AS base_fit,
        {S.six('penalties')} AS penalties, {S.six('availability')} AS availability,
        {S.six('location')} AS location, impossible, len(flags) AS n_flags FROM scored""",
        "scored",
    ),
)
def breakdown(data):
    """The breakdown record as JSON, read back field by field."""
    rows = sco.breakdown_json(scored_pool(data))
    kind = (
        "final double, base_fit double, penalties double, availability double, location double, "
        "impossible boolean, contributions map<string,double>, penalty_detail map<string,double>"
    )
    back = rows.select("id", F.from_json("breakdown", kind).alias("b")).select("id", "b.*")
    names = ("final", "base_fit", "penalties", "availability", "location")
    return back.select(
        "id", *[six(n).alias(n) for n in names], "impossible",
        big(F.size("penalty_detail")).alias("n_flags"),
    )


@query("k5_scored_survivors", S.using("SELECT id, score FROM scored", "scored"))
def survivors(data):
    return scored_pool(data).select("id", "score")


@query(
    "k6_scored_shortlist",
    S.using(
        f"""SELECT id, rank, {S.six('final')} AS final, trim(title) AS title
        FROM fullrank""",
        "fullrank",
    ),
)
def scored_shortlist(data):
    return full_ranking(data).select(
        "id", "rank", six("final").alias("final"), F.trim("title").alias("title")
    )


@query(
    "k7_explain",
    S.using(
        " UNION ALL ".join(
            f"SELECT id, {i}::BIGINT AS term_order, '{t}' AS term, {S.six(t)} AS raw, "
            f"{S.six(S.d(S.TERM_WEIGHTS[t]) + ' * ' + t)} AS contribution FROM fullrank "
            "WHERE rank <= 40"
            for i, t in enumerate(TERMS)
        ),
        "fullrank",
    ),
)
def explained(data):
    rows = sco.explain_terms(ranked_top(data, 40, "raw"))
    return rows.select(
        "id", big("term_order").alias("term_order"), "term", six("raw").alias("raw"),
        six("contribution").alias("contribution"),
    )


def _map(key: str, table: dict, default: str) -> str:
    arms = " ".join(
        "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in table.items()
    )
    return f"CASE {key} {arms} ELSE {default} END"


GAPS = f"""list_concat(list_transform(flags, lambda f: {_map('f', dict(FLAG_PHRASES),
                                                             "replace(f, '_', ' ')")}),
  list_filter([CASE WHEN notice >= 90 THEN notice::VARCHAR || '-day notice period' END,
    CASE WHEN availability < 0.85::DOUBLE THEN 'limited recent activity / engagement' END,
    CASE WHEN NOT is_open THEN 'not currently flagged open to work' END],
    lambda x: x IS NOT NULL))"""
FALLBACK = f"""CASE WHEN rank <= 10 THEN 'Top-tier match' WHEN rank <= 30 THEN 'Strong match'
  WHEN rank <= 60 THEN 'Solid match' ELSE 'Reasonable match' END ||
  ' for the retrieval / ranking role: ' || trim(title) || ' with ' ||
  coalesce(format('{{:g}}', years) || ' years'' experience', 'relevant experience') || ', ' ||
  {_map("coalesce(s_role, '')", dict(ROLE_PHRASES), "'a relevant engineering profile'")} ||
  CASE WHEN coalesce(s_built, false) THEN ', having shipped a ranking or search system' ELSE ''
  END || '.' || CASE WHEN len(gaps) = 0 THEN '' ELSE ' Noted gap: ' ||
  CASE WHEN len(gaps) = 1 THEN gaps[1] ELSE array_to_string(gaps[1:len(gaps) - 1], ', ') ||
  ' and ' || gaps[len(gaps)] END || '.' END"""
TOP_TEXT = f"SELECT *, {S.sq(FALLBACK)} AS fallback FROM (SELECT *, {GAPS} AS gaps FROM ranked)"
RANKED_OUTPUT = S.using(
    f"""SELECT w.id, rank, score, CASE WHEN coalesce({S.sq('t.text')}, '') <> '' THEN
    {S.sq('t.text')} ELSE fallback END AS reasoning FROM written w
    LEFT JOIN texts t ON t.id = w.id WHERE rank <= 100""",
    "ranked", "texts", written=TOP_TEXT,
)


@query("k8_ranked_output", RANKED_OUTPUT)
def output(data):
    """The flagship: the best hundred with score and explanation."""
    return ranked_output(data).select("id", "rank", "score", "reasoning")


@query(
    "q8_survivor_sample",
    S.using(
        f"""SELECT w.id, rank, score, CASE WHEN f.id IS NOT NULL THEN 'honeypot → 0' ELSE ''
        END AS note, CASE WHEN coalesce({S.sq('t.text')}, '') <> '' THEN 'llm' ELSE
        'deterministic' END AS reasoning_source FROM written w
        LEFT JOIN texts t ON t.id = w.id LEFT JOIN flagged f ON f.id = w.id""",
        "ranked", "texts", "flagged", written=TOP_TEXT,
    ),
)
def survivor_sample(data):
    """Every survivor ranked, with its integrity note and where its text came from."""
    ranked = positions(scored_pool(data), sco.order_by())
    texts = with_text(with_fallback(ranked, data.settings.text), data.texts, F.col("fallback"))
    return texts.select(
        "id", "rank", "score",
        F.when(F.col("impossible"), "honeypot → 0").otherwise("").alias("note"),
        F.when(F.col("text_source") == "cached", "llm").otherwise("deterministic").alias(
            "reasoning_source"),
    )


@query(
    "a5_with_signals",
    S.using(
        f"""SELECT sum(known::BIGINT)::BIGINT AS n_true, count(*) AS n,
        {S.six('sum(known::INT)::DOUBLE / count(*)::DOUBLE')} AS rate FROM feats""",
        "feats",
    ),
)
def known_rate(data):
    rows = true_rate(scored_pool(data), F.col("signal").isNotNull())
    return rows.withColumn("rate", six("rate"))
