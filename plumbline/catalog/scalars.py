"""Scalar projections and predicates (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import query, six
from plumbline.functions import scalar as sc
from plumbline.functions.cleaning import field
from plumbline.operators.ordering import positions
from plumbline.operators.scored import order_by
from plumbline.operators.shortlist import mark_targets, prefilter
from plumbline.plans.jobs import scored_pool


@query(
    "p1_normalize_title",
    f"""SELECT p_partkey, lower({S.sq("chr(9) || upper(p_name) || chr(160) || ' ' || p_type")})
    AS title FROM part""",
)
def normalize_title(data):
    raw = F.concat(F.lit("\t"), F.upper("p_name"), F.lit("  "), F.col("p_type"))
    return data.table("part").select("p_partkey", sc.normalize_title(raw).alias("title"))


@query("p2_target_title", S.using("SELECT id, is_target FROM rec", "rec"))
def target_title(data):
    return mark_targets(data.pool, data.settings.filter).select("id", "is_target")


@query(
    "p3_prefilter",
    S.using(f"SELECT id, {S.six('cosine')} AS cosine FROM matched", "matched"),
)
def prefilter_survivors(data):
    kept = prefilter(data.pool, data.similarity, data.settings.filter)
    return kept.select("id", six("cosine").alias("cosine"))


_BRANCH = f"""CASE WHEN is_target AND cosine >= {S.d(S.THRESHOLD)} THEN 'both'
  WHEN is_target THEN 'archetype' ELSE 'similarity' END"""


@query("p4_filter_branch", S.using(f"SELECT id, {_BRANCH} AS branch FROM matched", "matched"))
def branches(data):
    return prefilter(data.pool, data.similarity, data.settings.filter).select("id", "branch")


@query(
    "p5_clip",
    S.using(f"SELECT id, {S.six(S.clip('cosine * 4.0::DOUBLE'))} AS clipped FROM sims", "sims"),
)
def clipped(data):
    return data.similarity.select("id", six(sc.clip01(F.col("cosine") * 4.0)).alias("clipped"))


@query(
    "p6_rescale",
    S.using(f"SELECT id, {S.six(S.rescale('cosine', -0.1, 0.3))} AS fit FROM sims", "sims"),
)
def rescaled(data):
    score = data.settings.score
    fit = sc.rescale(F.col("cosine"), score.cosine_floor, score.cosine_ceiling)
    return data.similarity.select("id", six(fit).alias("fit"))


def _behaviour(name: str, part: str) -> str:
    return S.using(f"SELECT id, {S.six(S.BLEND_PARTS[part])} AS {name} FROM pool", "pool")


@query("p7_unit_rate", _behaviour("rate", "recruiter_response_rate"))
def unit_rate(data):
    rate = F.col("activity.recruiter_response_rate")
    return data.pool.select("id", six(sc.unit_rate(rate)).alias("rate"))


@query("p8_sentinel_rate", _behaviour("rate", "offer_acceptance"))
def sentinel_rate(data):
    rate = F.col("activity.offer_acceptance_rate")
    return data.pool.select("id", six(sc.sentinel_rate(rate)).alias("rate"))


@query("p9_flag_score", _behaviour("score", "open_to_work"))
def flag_score(data):
    flag = F.col("activity.open_to_work_flag")
    score = sc.flag_score(flag, 1.0, data.settings.score.not_open_score)
    return data.pool.select("id", six(score).alias("score"))


@query("p10_notice_period", _behaviour("score", "notice_period"))
def notice_period(data):
    days = F.col("activity.notice_period_days")
    score = sc.notice_score(days, data.settings.score.notice_days)
    return data.pool.select("id", six(score).alias("score"))


@query("p11_recency", _behaviour("score", "recency"))
def recency(data):
    s = data.settings.score
    score = sc.recency_score(F.col("activity.last_active_date"), s.snapshot_date, s.recency_days)
    return data.pool.select("id", six(score).alias("score"))


@query(
    "p12_iso_date",
    """WITH t AS (SELECT o_orderkey, CASE o_orderstatus
      WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 'O' THEN
      strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS raw,
      o_orderstatus AS st, o_orderdate::DATE AS day FROM orders)
    SELECT o_orderkey, CASE WHEN st <> 'O' THEN day::VARCHAR END AS day FROM t""",
)
def iso_dates(data):
    when = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(when, "yyyy-MM-dd'T'HH:mm"))
        .when(F.col("o_orderstatus") == "O", F.date_format(when, "yyyy/MM/dd"))
        .otherwise(F.date_format(when, "yyyyMMdd"))
    )
    return data.table("orders").select(
        "o_orderkey", sc.iso_date(raw).cast("string").alias("day")
    )


_ROLE = S.cases("role", dict(S.SCORE.role_scores), S.d(S.SCORE.default_role_score))
_DOMAIN = S.cases("domain", dict(S.SCORE.domain_scores), S.d(S.SCORE.default_domain_score))


@query(
    "p13_vocabulary_score",
    S.using(
        f"SELECT id, {S.six(_ROLE)} AS role_score, {S.six(_DOMAIN)} AS domain_score FROM signals",
        "signals",
    ),
)
def vocabulary_scores(data):
    s = data.settings.score
    role = sc.lookup(F.col("role_archetype"), s.role_scores, s.default_role_score)
    domain = sc.lookup(F.col("domain"), s.domain_scores, s.default_domain_score)
    return data.signals.select(
        "id", six(role).alias("role_score"), six(domain).alias("domain_score")
    )


@query("p14_location", S.using(f"SELECT id, {S.six('location')} AS location FROM rec", "rec"))
def locations(data):
    s = data.settings.score
    score = sc.location_score(
        F.col("profile.country"), F.col("activity.willing_to_relocate"), s.home_country,
        s.away_score,
    )
    return data.pool.select("id", six(score).alias("location"))


@query(
    "p15_format_score",
    f"SELECT o_orderkey, {S.six('o_totalprice / 7.0::DOUBLE')} AS score FROM orders",
)
def formatted(data):
    return data.table("orders").select(
        "o_orderkey", sc.fixed(F.col("o_totalprice") / 7.0).alias("score")
    )


@query(
    "p16_rank_tone",
    S.using(
        """SELECT id, CASE WHEN rank <= 10 THEN 'top-tier match' WHEN rank <= 30 THEN
        'strong match' WHEN rank <= 60 THEN 'solid match' ELSE 'reasonable match' END AS tone
        FROM ranked""",
        "ranked",
    ),
)
def tones(data):
    ranked = positions(scored_pool(data).select("id", "score_value"), order_by())
    return ranked.select("id", sc.rank_tone(F.col("rank")).alias("tone"))


@query(
    "p17_typed_access",
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
      json_extract_string(props, '$.missing') AS missing,
      json_extract_string(props, '$.k')::DOUBLE > 50 AS large FROM events""",
)
def typed_access(data):
    record = F.try_parse_json("props")
    return data.table("events").select(
        "event_id",
        field(record, "k", "bigint").alias("k"),
        field(record, "missing", "string").alias("missing"),
        (field(record, "k", "double") > 50).alias("large"),
    )


@query(
    "p18_years_to_months",
    S.using(f"SELECT id, {S.six('years * 12.0::DOUBLE')} AS months FROM docs", "docs"),
)
def months(data):
    years = F.col("profile.years_of_experience")
    return data.pool.select("id", six(sc.years_to_months(years)).alias("months"))


