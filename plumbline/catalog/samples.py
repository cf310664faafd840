"""Review samples and draft labels (L*, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, query
from plumbline.catalog.texts import EXCERPT
from plumbline.operators import sampling
from plumbline.operators.durable import durable
from plumbline.operators.summary import category_counts
from plumbline.plans.jobs import full_ranking

# (name, quota, member, order) of the strata, in the order they choose.
_STRATA = [
    ("clear_fit", 16, "true", "rank"),
    ("inactive_but_perfect", 6, "base_fit >= 0.85::DOUBLE AND availability <= low",
     "availability, rank"),
    ("cv_bait", 6, "list_contains(flags, 'cv_primary')", "rank"),
    ("consulting_only", 4, "list_contains(flags, 'consulting_only')", "rank"),
    ("job_hopper", 3, "list_contains(flags, 'job_hopper')", "rank"),
    ("stale_coding", 2, "list_contains(flags, 'stale_coding')", "rank"),
    ("semantic_mismatch", 4, "career_sim >= 0.80::DOUBLE AND role_match <= 0.30::DOUBLE", "rank"),
    ("title_surprise", 5, "rank <= 320 AND NOT is_target", "rank"),
    ("mid_band", 10, "mid", "rank"),
    ("low_band", 6, "low_band", "rank"),
    ("honeypot", 4, "impossible", "rank"),
    ("bottom_floor", 3, "true", "rank DESC"),
]


def _band(lo: float, hi: float, count: int) -> str:
    start, stop = f"floor(n * {S.d(lo)})::BIGINT", f"floor(n * {S.d(hi)})::BIGINT"
    step = f"greatest(1, ({stop} - {start}) // {count})"
    return (
        f"(rank - 1 >= {start} AND rank - 1 < {stop} AND (rank - 1 - {start}) % {step} = 0 "
        f"AND (rank - 1 - {start}) // {step} < {count})"
    )


def _views() -> dict[str, str]:
    """One view per stratum, each skipping what earlier strata took."""
    views = {
        "sized": "SELECT *, count(*) OVER () AS n FROM fullrank",
        "lowest": "SELECT availability AS low FROM (SELECT availability, n, row_number() OVER "
                  "(ORDER BY availability) AS p FROM sized) "
                  "WHERE p = floor(0.2::DOUBLE * (n - 1))::BIGINT + 1",
        "banded": f"SELECT *, {_band(0.25, 0.60, 10)} AS mid, {_band(0.72, 0.95, 6)} "
                  "AS low_band FROM sized, lowest",
    }
    taken: list[str] = []
    for i, (name, quota, member, order) in enumerate(_STRATA):
        seen = " UNION ALL ".join(f"SELECT id FROM s{j}" for j in range(i))
        skip = f" AND id NOT IN ({seen})" if seen else ""
        views[f"s{i}"] = (
            f"SELECT id, '{name}' AS category, {i} AS stratum, rank, row_number() OVER "
            f"(ORDER BY {order}) AS place FROM banded WHERE {member}{skip} "
            f"ORDER BY {order} LIMIT {quota}"
        )
        taken.append(f"SELECT * FROM s{i}")
    views["picks"] = (
        "SELECT *, row_number() OVER (ORDER BY stratum, place) AS pick FROM ("
        + " UNION ALL ".join(taken) + ")"
    )
    return views


PICKS = _views()


@query(
    "w10_quota_sample",
    S.using("SELECT pick, id, category, rank FROM picks", "fullrank", **PICKS),
)
def quota_sample(data):
    ranking = durable(full_ranking(data))
    picks = sampling.select_sample(ranking)
    return picks.select(big("pick").alias("pick"), "id", "category", "rank")


@query(
    "a15_category_counts",
    S.using(
        "SELECT category, count(*) AS n, min(pick) AS first_pick FROM picks GROUP BY category",
        "fullrank", **PICKS,
    ),
)
def counted(data):
    counts = category_counts(sampling.select_sample(durable(full_ranking(data))))
    return counts.select("category", "n", big("first_pick").alias("first_pick"))


_REASONS = {
    "clear_fit": "'top of the ranking — should be a clear fit'",
    "inactive_but_perfect": f"'strong fit (base=' || {S.fix('base_fit', 2)} || "
    f"') but low availability (' || {S.fix('availability', 2)} || ') — ranker must still surface "
    "them'",
    "cv_bait": "'CV/speech-primary bait the JD excludes (highest-ranked first = most dangerous)'",
    "consulting_only": "'consulting/services-only career the JD excludes'",
    "job_hopper": "'job-hopper flag'",
    "stale_coding": "'stale-coding flag'",
    "semantic_mismatch": "'embedding says relevant but the role/domain is off (CV/speech) — must "
    "NOT float up'",
    "title_surprise": "'title ''' || title || ''' is not an archetype, but career ranks #' || "
    "f.rank || ' — a plain-language fit the title would hide'",
    "mid_band": "'mid-distribution (#' || f.rank || ')'",
    "low_band": "'low-distribution (#' || f.rank || ')'",
    "honeypot": "'honeypot in the ranking'",
    "bottom_floor": "'very bottom of the ranking (#' || f.rank || ')'",
}


@query(
    "l1_stratum_reasons",
    S.using(
        "SELECT pick, p.id, CASE category "
        + " ".join(f"WHEN '{n}' THEN {e}" for n, e in _REASONS.items())
        + " END AS reason FROM picks p JOIN fullrank f ON f.id = p.id",
        "fullrank", **PICKS,
    ),
)
def reasons(data):
    picks = sampling.select_sample(durable(full_ranking(data)))
    return picks.select(big("pick").alias("pick"), "id", "reason")


_ON = "role_match >= 0.90::DOUBLE AND domain_match >= 0.90::DOUBLE"
_OFF = "role_match <= 0.20::DOUBLE AND domain_match <= 0.20::DOUBLE"
_IDEAL = f"base_fit >= 0.85::DOUBLE AND {_ON} AND built_ranking >= 1"
_TIER = f"""CASE WHEN {_OFF} THEN CASE WHEN base_fit >= 0.45::DOUBLE THEN 1 ELSE 0 END
  WHEN {_IDEAL} THEN 5 WHEN base_fit >= 0.70::DOUBLE AND {_ON} THEN 4
  WHEN base_fit >= 0.55::DOUBLE THEN 3 WHEN base_fit >= 0.40::DOUBLE THEN 2 ELSE 1 END"""
_WHY = f"""CASE WHEN {_OFF} THEN 'off-target CV/speech or non-tech role+domain'
  WHEN {_IDEAL} THEN 'ideal: on-target role+domain, shipped ranking/search, strong fit'
  WHEN base_fit >= 0.70::DOUBLE AND {_ON} THEN 'strong on-target production ML'
  WHEN base_fit >= 0.55::DOUBLE
    THEN 'genuine applied ML; IR/ranking or product evidence thinner'
  WHEN base_fit >= 0.40::DOUBLE THEN 'weak / adjacent fit' ELSE 'very weak fit' END"""
_HARD = """list_sort(list_filter(flags, lambda f: f IN ('cv_primary', 'consulting_only',
  'pure_research', 'langchain_only_recent')))"""
_SOFT = "list_sort(list_filter(flags, lambda f: f IN ('stale_coding', 'job_hopper')))"
DRAFT = {
    "drafted": f"SELECT *, {_TIER} AS t0, {_WHY} AS why, {_HARD} AS hard, {_SOFT} AS soft "
               "FROM fullrank",
    "capped": "SELECT *, CASE WHEN len(hard) > 0 AND t0 > 2 THEN 2 ELSE t0 END AS t1 "
              "FROM drafted",
    "tiers": f"""SELECT *, (CASE WHEN impossible THEN 0 WHEN len(soft) > 0 AND t1 > 1 THEN t1 - 1
      ELSE t1 END)::BIGINT AS draft, CASE WHEN impossible
      THEN 'honeypot — impossible profile (deliberate trap) → always tier 0' ELSE why ||
      CASE WHEN len(hard) > 0 AND t0 > 2 THEN '; hard disqualifier [''' ||
        array_to_string(hard, ''', ''') || '''] the JD excludes → capped at 2' ELSE '' END ||
      CASE WHEN len(soft) > 0 AND t1 > 1 THEN '; soft flag [''' ||
        array_to_string(soft, ''', ''') || '''] → -1' ELSE '' END ||
      ' (base=' || {S.fix('base_fit', 2)} || ')' END AS rationale FROM capped""",
}


@query(
    "l2_draft_tier",
    S.using("SELECT id, draft AS tier, rationale FROM tiers", "fullrank", **DRAFT),
)
def draft_tier(data):
    tier, rationale = sampling.draft_tier()
    return full_ranking(data).select("id", big(tier).alias("tier"), rationale.alias("rationale"))


def _clip(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({S.sq(text)}) <= {limit} THEN {S.sq(text)} ELSE "
        f"rtrim(substring({S.sq(text)}, 1, {limit - 1})) || '…' END"
    )


_SHEET = f"""SELECT p.category, p.rank, p.id, title AS current_title, {S.six('years')}
    AS years_experience, lang AS country, coalesce(s_role, '') AS role_archetype,
    coalesce(s_domain, '') AS domain, {S.fix('built_ranking', 0)} AS built_ranking,
    {S.fix('product_ratio', 2)} AS product_ratio, {S.fix('seniority_fit', 2)} AS seniority_fit,
    array_to_string(flags, ', ') AS disqualifier_flags, impossible, {S.fix('final', 3)} AS final,
    {S.fix('base_fit', 3)} AS base_fit, {S.fix('availability', 3)} AS availability,
    {S.fix('location', 2)} AS location, {S.fix('career_sim', 3)} AS career_sim,
    {S.fix('lexical_evidence', 2)} AS lexical_evidence, {_clip('s_evidence', 300)}
    AS evidence_span, {_clip('summary', 280)} AS summary, {EXCERPT} AS career_history,
    draft AS suggested_tier, '[SUGGESTION — overwrite] ' || CASE category
    {' '.join(f"WHEN '{n}' THEN {e}" for n, e in _REASONS.items())} END || '; ' || rationale
    AS suggested_rationale, '' AS tier, '' AS note
  FROM picks p JOIN tiers f ON f.id = p.id"""


def _picked(data):
    ranking = durable(full_ranking(data))
    return sampling.review_rows(sampling.select_sample(ranking), ranking, data.texts_pool), ranking


@query("l3_review_rows", S.using(_SHEET, "fullrank", **PICKS, **DRAFT))
def review_rows(data):
    rows, _ = _picked(data)
    shown = {"years_experience": F.call_function("format_number", F.col("years_experience"),
                                                 F.lit("0.000000")),
             "suggested_tier": big("suggested_tier")}
    return rows.withColumns(shown).select(*sampling.REVIEW_COLUMNS)


@query(
    "l4_outside_rows",
    S.using(
        f"""SELECT f.id, title AS current_title, lang AS country, true AS impossible,
        {_clip('summary', 280)} AS summary, {EXCERPT} AS career_history,
        '[SUGGESTION — overwrite] honeypot (' || array_to_string(reasons, ', ') ||
        ') excluded by the pre-filter → tier 0' AS suggested_rationale
        FROM (SELECT * FROM flagged WHERE id NOT IN (SELECT id FROM matched) ORDER BY id LIMIT 2)
        f JOIN docs ON docs.id = f.id""",
        "docs", "flagged", "matched",
    ),
)
def outside_rows(data):
    ranking = full_ranking(data).select("id")
    flagged = sampling.outside_flagged(data.flagged, ranking)
    rows = sampling.outside_rows(flagged, data.texts_pool)
    return rows.select("id", "current_title", "country", "impossible", "summary",
                       "career_history", "suggested_rationale")


_OUTSIDE = f"""SELECT 'honeypot_pool' AS category, f.id, title AS current_title,
    {S.fix('years', 1)} AS years_experience, lang AS country, true AS impossible,
    {_clip('summary', 280)} AS summary, {EXCERPT} AS career_history, 0 AS suggested_tier,
    '[SUGGESTION — overwrite] honeypot (' || array_to_string(reasons, ', ') ||
    ') excluded by the pre-filter → tier 0' AS suggested_rationale
    FROM (SELECT * FROM flagged WHERE id NOT IN (SELECT id FROM matched) ORDER BY id LIMIT 2)
    f JOIN docs ON docs.id = f.id"""


def _card() -> str:
    """The card of a row of ``sheet``, whose years are text."""
    facts = [
        f"""'| {label} | ' || replace(regexp_replace(nullif({name}::VARCHAR, ''),
          '[ \\t\\n\\r]+', ' ', 'g'), '|', '\\|') || ' |'"""
        for label, name in sampling.CARD_FACTS.items()
    ]
    texts = [
        f"""chr(10) || '> **{label}.** ' ||
          replace(nullif({name}::VARCHAR, ''), chr(10), chr(10) || '> ')"""
        for label, name in sampling.CARD_TEXTS.items()
    ]
    head = ["'### `' || id || '`' || chr(10)", "'| Fact | Value |' || chr(10) || '| --- | --- |'"]
    tail = """chr(10) || 'Draft tier: ' || coalesce(suggested_tier::VARCHAR, 'none') || chr(10) ||
      'Decision:' || chr(10) || 'Remarks:' || chr(10)"""
    return "concat_ws(chr(10), " + ", ".join([*head, *facts, *texts, tail]) + ")"


@query(
    "s19_review_cards",
    S.using(
        f"""SELECT category, coalesce(rank, {1 << 62})::BIGINT AS place, id, {_card()} AS value
        FROM sheet UNION ALL SELECT category, -1::BIGINT, '', '## ' || category || ' (' || count(*)
        || ')' || chr(10) FROM sheet GROUP BY category""",
        "fullrank", "docs", "flagged", "matched", **PICKS, **DRAFT,
        picked=_SHEET.replace(S.six("years"), S.fix("years", 1)), outside=_OUTSIDE,
        sheet="SELECT * FROM picked UNION ALL BY NAME SELECT * FROM outside",
    ),
)
def review_cards(data):
    rows, ranking = _picked(data)
    outside = sampling.outside_rows(
        sampling.outside_flagged(data.flagged, ranking), data.texts_pool
    )
    cards = sampling.review_cards(sampling.review_sheet(rows, outside))
    return sampling.card_lines(durable(cards))
