"""SQL side of the catalog: the pool views as common table expressions."""

from __future__ import annotations

from plumbline.config import (
    AVAILABILITY_WEIGHTS,
    DOMAINS,
    FLAG_PENALTIES,
    ROLES,
    TERM_WEIGHTS,
    TERMS,
    ordered_sum,
)
from plumbline.plans.dataset import KEYWORDS, SETTINGS

SCORE = SETTINGS.score
WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


def d(value: float) -> str:
    return f"{float(value)!r}::DOUBLE"


def sq(text: str) -> str:
    return f"coalesce(trim(regexp_replace({text}, '{WS}', ' ', 'g')), '')"


def six(value: str) -> str:
    return f"format('{{:.6f}}', {value})"


def fix(value: str, decimals: int) -> str:
    return f"format('{{:.{decimals}f}}', {value})"


def clip(value: str) -> str:
    return f"greatest({d(0)}, least({d(1)}, {value}))"


def rescale(value: str, low: float, high: float) -> str:
    return clip(f"({value} - {d(low)}) / {d(high - low)}")


def cases(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contains_any(text: str, words) -> str:
    tests = " OR ".join(f"contains({text}, '{w}')" for w in words)
    return f"({tests})"


def number(text: str) -> str:
    return f"'DOC_' || lpad({text}::VARCHAR, 12, '0')"


_total = ordered_sum(AVAILABILITY_WEIGHTS.values())
_blend_parts = {
    "recency": f"CASE WHEN last_active IS NULL THEN {d(.5)} "
    f"WHEN date_diff('day', last_active::DATE, DATE '{SCORE.snapshot_date}') <= 0 THEN {d(1)} "
    "ELSE "
    + clip(
        f"{d(1)} - date_diff('day', last_active::DATE, DATE '{SCORE.snapshot_date}')::DOUBLE "
        f"/ {d(SCORE.recency_days)}"
    )
    + " END",
    "recruiter_response_rate": f"CASE WHEN r_resp IS NULL THEN {d(.5)} ELSE {clip('r_resp')} END",
    "open_to_work": f"CASE WHEN is_open THEN {d(1)} WHEN NOT is_open THEN "
    f"{d(SCORE.not_open_score)} ELSE {d(.5)} END",
    "interview_completion_rate": f"CASE WHEN r_int IS NULL THEN {d(.5)} ELSE {clip('r_int')} END",
    "notice_period": f"CASE WHEN notice IS NULL THEN {d(.5)} ELSE "
    + clip(f"{d(1)} - notice::DOUBLE / {d(SCORE.notice_days)}")
    + " END",
    "offer_acceptance": f"CASE WHEN r_offer IS NULL OR r_offer < 0 THEN {d(.5)} ELSE "
    f"{clip('r_offer')} END",
    "verified_email": f"CASE WHEN v_email THEN {d(1)} WHEN NOT v_email THEN {d(0)} "
    f"ELSE {d(.5)} END",
    "verified_phone": f"CASE WHEN v_phone THEN {d(1)} WHEN NOT v_phone THEN {d(0)} "
    f"ELSE {d(.5)} END",
}
BLEND_PARTS = _blend_parts
BLEND = (
    "("
    + " + ".join(
        [d(0)] + [f"{d(AVAILABILITY_WEIGHTS[n])} * ({e})" for n, e in _blend_parts.items()]
    )
    + f") / {d(_total)}"
)
AVAILABILITY = (
    f"{d(SCORE.availability_floor)} + ({d(1)} - {d(SCORE.availability_floor)}) * blend"
)
LEXICAL = (
    "("
    + " + ".join(f"{contains_any('low_text', w)}::INT" for w in KEYWORDS.values())
    + f")::DOUBLE / {d(len(KEYWORDS))}"
)
BASE = " + ".join([d(0)] + [f"{d(TERM_WEIGHTS[t])} * {t}" for t in TERMS])
PENALTY = cases("f", dict(FLAG_PENALTIES), d(0))
THRESHOLD = SETTINGS.filter.threshold
TITLES = quoted(SETTINGS.filter.titles)
MARGIN = SETTINGS.integrity.role_margin_months

_DOCS = f"""
SELECT {number('doc_id')} AS id, doc_id, source, lang, n_chars, text,
  ' ' || upper(source) || ' ' AS title, source || '  in ' || lang AS summary,
  n_chars::DOUBLE / {d(120)} AS years,
  CASE WHEN lang = 'en' THEN ' Expert ' ELSE 'advanced' END AS proficiency,
  floor(n_chars::DOUBLE / {d(300)})::INT AS skill_months,
  list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
    lambda x, i: {{'company': lang, 'title': source, 'description': x,
      'months': floor(length(x)::DOUBLE / {d(8)})::INT,
      'start': DATE '2020-01-01' + (i - 1)::INT,
      'stop': CASE WHEN i > 1 THEN DATE '2020-01-01' + (i - 1)::INT + (length(x) - 4)::INT END
    }}) AS career
FROM documents"""
_ACT = """
SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS last_active,
  bool_or(event_type = 'signup' AND value > 60) AS is_open,
  sum((event_type = 'click')::INT)::DOUBLE / count(*)::DOUBLE AS r_resp,
  max(json_extract_string(props, '$.k')::INT) AS notice,
  bool_or(event_type = 'view' AND value > 60) AS relocates,
  sum((event_type = 'view')::INT)::DOUBLE / count(*)::DOUBLE AS r_int,
  CASE WHEN sum((event_type = 'purchase')::INT) < 10 THEN -1.0::DOUBLE
    ELSE sum((event_type = 'purchase')::INT)::DOUBLE / count(*)::DOUBLE END AS r_offer,
  bool_or(event_type = 'click' AND value > 50) AS v_email,
  bool_or(event_type = 'error' AND value > 50) AS v_phone
FROM events GROUP BY user_id"""
_TEXT = f"""
SELECT *, array_to_string(list_filter(
    list_concat([{sq('title')}, {sq('summary')}],
      list_transform(career, lambda r: {sq('r.description')})),
    lambda p: p <> ''), ' ') AS career_text
FROM docs LEFT JOIN act ON doc_id = user_id"""
_REC = f"""
SELECT *, lower(career_text) AS low_text, lower({sq('title')}) AS norm_title,
  lower({sq('title')}) IN ({TITLES}) AS is_target, {BLEND} AS blend,
  CASE WHEN lower(trim(lang)) = '{SCORE.home_country}' OR coalesce(relocates, false)
    THEN {d(1)} ELSE {d(SCORE.away_score)} END AS location
FROM pool"""
_FLAGGED = f"""
SELECT id, reasons FROM (
  SELECT id, list_sort(list_filter([
    CASE WHEN lower(trim(proficiency)) = 'expert' AND skill_months = 0
      THEN 'expert_zero_duration' END,
    CASE WHEN years * 12.0::DOUBLE > 0 AND len(list_filter(career,
      lambda r: r.months >= years * 12.0::DOUBLE + {MARGIN})) > 0
      THEN 'role_exceeds_experience' END,
    CASE WHEN len(list_filter(career, lambda r: r.months < 0 OR
      coalesce(r.stop < r.start, false))) > 0 THEN 'impossible_timeline' END
  ], lambda x: x IS NOT NULL)) AS reasons FROM pool) WHERE len(reasons) > 0"""
_SIGNALS = f"""
SELECT {number('doc_id')} AS id,
  coalesce(list_extract([{quoted(ROLES)}], label + 1), 'unlisted') AS role,
  coalesce(list_extract([{quoted(DOMAINS)}], label + 1), 'unlisted') AS domain,
  CASE WHEN quality = 1 THEN {d(.9)} ELSE {d(.2)} END AS product,
  coalesce(label::DOUBLE / {d(9)}, {d(.5)}) AS seniority,
  quality = 1 AND coalesce(label < 5, false) AS built,
  'Label ' || coalesce(label::VARCHAR, 'none') || ' quality ' || quality::VARCHAR AS evidence,
  list_filter([CASE WHEN toxic = 1 THEN 'cv_primary' END,
    CASE WHEN quality = 0 THEN 'stale_coding' END, CASE WHEN label = 9 THEN 'job_hopper' END,
    CASE WHEN label = 5 THEN 'consulting_only' END, CASE WHEN label = 7 THEN 'other_flag' END],
    lambda x: x IS NOT NULL) AS flags
FROM labels LEFT JOIN embeddings ON doc_id = vec_id"""
_FEATS = f"""
SELECT m.*, s.role AS s_role, s.domain AS s_domain, s.evidence AS s_evidence,
  s.built AS s_built, s.product AS s_product, s.seniority AS s_seniority,
  s.id IS NOT NULL AS known, f.id IS NOT NULL AS impossible,
  coalesce(s.flags, []::VARCHAR[]) AS flags,
  {rescale('m.cosine', SCORE.cosine_floor, SCORE.cosine_ceiling)} AS career_sim,
  CASE WHEN s.id IS NOT NULL THEN {cases('s.role', dict(SCORE.role_scores),
                                         d(SCORE.default_role_score))}
    ELSE {rescale('m.cosine', SCORE.cosine_floor, SCORE.cosine_ceiling)} END AS role_match,
  CASE WHEN s.id IS NOT NULL THEN {cases('s.domain', dict(SCORE.domain_scores),
                                         d(SCORE.default_domain_score))}
    ELSE {rescale('m.cosine', SCORE.cosine_floor, SCORE.cosine_ceiling)} END AS domain_match,
  CASE WHEN s.id IS NOT NULL THEN {clip('s.product')} ELSE {d(.5)} END AS product_ratio,
  CASE WHEN s.id IS NOT NULL THEN {clip('s.seniority')} ELSE {d(.5)} END AS seniority_fit,
  CASE WHEN s.id IS NOT NULL AND s.built THEN {d(1)} ELSE {d(0)} END AS built_ranking,
  {LEXICAL} AS lexical_evidence, {AVAILABILITY} AS availability
FROM matched m LEFT JOIN signals s ON m.id = s.id LEFT JOIN flagged f ON m.id = f.id"""
_SCORED = f"""
SELECT *, {six('final')} AS score FROM (
  SELECT *, CASE WHEN impossible THEN {d(0)}
    ELSE greatest({d(0)}, base_fit - penalties) * availability * location END AS final FROM (
    SELECT *, {BASE} AS base_fit,
      list_reduce(list_prepend({d(0)}, list_transform(flags, lambda f: {PENALTY})),
        lambda a, b: a + b) AS penalties
    FROM feats))"""
_RANKED = """
SELECT *, row_number() OVER (ORDER BY score::DOUBLE DESC, id) AS rank FROM scored"""
_FULL = """
SELECT *, row_number() OVER (ORDER BY final DESC, id) AS rank FROM scored"""
_GOLD = f"""
SELECT {number('doc_id')} AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 4
  WHEN quality = 1 AND toxic = 1 THEN 2 WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS tier
FROM labels"""
_TEXTS = f"""
SELECT {number('conv_id')} AS id, arg_max(text, turn) AS text,
  CASE WHEN arg_max(role, turn) = 'assistant' THEN 'llm' ELSE 'deterministic' END AS source
FROM conversations GROUP BY conv_id"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), _DOCS),
    "act": ((), _ACT),
    "pool": (("docs", "act"), _TEXT),
    "rec": (("pool",), _REC),
    "vecs": ((), f"SELECT {number('vec_id')} AS id, label, embedding::DOUBLE[] AS e FROM "
                 "embeddings"),
    "ref": ((), "SELECT embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id = 0"),
    "sims": (("vecs", "ref"), "SELECT id, label, list_inner_product(e, r) AS cosine "
                              "FROM vecs, ref"),
    "flagged": (("pool",), _FLAGGED),
    "signals": ((), _SIGNALS),
    "joined": (("rec", "sims"), "SELECT rec.*, coalesce(cosine, -1.0::DOUBLE) AS cosine, "
                                "cosine IS NOT NULL AS has_vector "
                                "FROM rec LEFT JOIN sims ON rec.id = sims.id"),
    "matched": (("joined",), f"SELECT * FROM joined WHERE is_target OR cosine >= {d(THRESHOLD)}"),
    "feats": (("matched", "signals", "flagged"), _FEATS),
    "scored": (("feats",), _SCORED),
    "ranked": (("scored",), _RANKED),
    "fullrank": (("scored",), _FULL),
    "gold": ((), _GOLD),
    "texts": ((), _TEXTS),
    "judged": (("fullrank", "gold"), "SELECT fullrank.*, gold.tier FROM fullrank JOIN gold "
                                     "ON fullrank.id = gold.id"),
}


def using(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named views and everything they need; extras come last."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    views = [f"{n} AS ({VIEWS[n][1].strip()})" for n in order]
    views += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return "WITH " + ",\n".join(views) + "\n" + body.strip()
