"""Ranking metrics and checks (E*), parameter sweeps (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, query, six
from plumbline.catalog.vectors import CENTROIDS, QUERY_SCORES
from plumbline.config import TERMS
from plumbline.operators import metrics, sweep
from plumbline.operators import similarity as sim
from plumbline.operators.durable import durable
from plumbline.operators.membership import restrict
from plumbline.operators.ordering import positions
from plumbline.plans.dataset import SETTINGS
from plumbline.plans.jobs import (
    calibration,
    evaluation,
    full_ranking,
    judged_ranking,
    ranked_top,
    shortlist,
    sweep_features,
)

METRIC = SETTINGS.metric

# --- many queries: one per vector class, judged by the gold tiers -------------

_QJUDGED = f"""SELECT r.query, r.id, r.rank, gold.tier FROM (SELECT query, id, row_number() OVER
  (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM scores) r
  JOIN gold ON gold.id = r.id"""
_QVIEWS = {"centroids": CENTROIDS, "scores": QUERY_SCORES, "qj": _QJUDGED}
_PLACED = """SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place,
  row_number() OVER (PARTITION BY query ORDER BY tier DESC, id) AS ideal FROM qj"""


def _judged_queries(data):
    """Judged rows of every query in the order of its ranking; no other row is scored."""
    judged = restrict(data.vectors, data.gold)
    scores = sim.score_queries(judged, sim.centroids(data.vectors, "label"))
    order = [F.col("cosine").desc(), F.col("id").asc()]
    return metrics.judge(positions(scores, order, ["query"]), data.gold)


def _dcg_sql(place: str, k: int) -> str:
    return (
        f"coalesce(sum(CASE WHEN {place} <= {k} THEN tier::DOUBLE / "
        f"log2({place}::DOUBLE + 1.0::DOUBLE) END), 0.0::DOUBLE)"
    )


@query(
    "e1_dcg",
    S.using(
        f"""SELECT query::BIGINT AS query, {S.six(_dcg_sql('place', 10))} AS dcg_at_10,
        {S.six(_dcg_sql('place', 50))} AS dcg_at_50 FROM p GROUP BY query""",
        "vecs", "gold", **_QVIEWS, p=_PLACED,
    ),
)
def dcg(data):
    rows = metrics.dcg(_judged_queries(data), ["query"])
    return rows.select(big("query").alias("query"), six("dcg_at_10").alias("dcg_at_10"),
                       six("dcg_at_50").alias("dcg_at_50"))


def _ndcg_sql(k: int) -> str:
    return (
        f"CASE WHEN {_dcg_sql('ideal', k)} = 0 THEN 0.0::DOUBLE ELSE "
        f"{_dcg_sql('place', k)} / {_dcg_sql('ideal', k)} END"
    )


@query(
    "e2_ndcg",
    S.using(
        f"""SELECT query::BIGINT AS query, {S.six(_ndcg_sql(10))} AS ndcg_at_10,
        {S.six(_ndcg_sql(50))} AS ndcg_at_50 FROM p GROUP BY query""",
        "vecs", "gold", **_QVIEWS, p=_PLACED,
    ),
)
def ndcg(data):
    rows = metrics.ndcg(_judged_queries(data), ["query"])
    return rows.select(big("query").alias("query"), six("ndcg_at_10").alias("ndcg_at_10"),
                       six("ndcg_at_50").alias("ndcg_at_50"))


@query("e3_relevance", S.using("SELECT id, tier >= 3 AS relevant FROM gold", "gold"))
def relevance(data):
    relevant = metrics.is_relevant(F.col("tier"), METRIC.relevant_tier)
    return data.gold.select("id", relevant.alias("relevant"))


@query(
    "e4_precision",
    S.using(
        f"""SELECT query::BIGINT AS query,
        {S.six('sum((tier >= 3 AND place <= 10)::INT)::DOUBLE / 10.0::DOUBLE')}
        AS precision_at_10 FROM p GROUP BY query""",
        "vecs", "gold", **_QVIEWS, p=_PLACED,
    ),
)
def precision(data):
    rows = metrics.precision(_judged_queries(data), ["query"], 10, METRIC.relevant_tier)
    return rows.select(big("query").alias("query"),
                       six("precision_at_10").alias("precision_at_10"))


_AP = """SELECT query, coalesce(avg(CASE WHEN tier >= 3 THEN hits::DOUBLE / place::DOUBLE END),
  0.0::DOUBLE) AS ap FROM (SELECT query, tier, place,
  sum((tier >= 3)::INT) OVER (PARTITION BY query ORDER BY place ROWS UNBOUNDED PRECEDING) AS hits
  FROM p) GROUP BY query"""


@query(
    "e5_average_precision",
    S.using(
        f"SELECT query::BIGINT AS query, {S.six('ap')} AS average_precision FROM aps",
        "vecs", "gold", **_QVIEWS, p=_PLACED, aps=_AP,
    ),
)
def average_precision(data):
    rows = metrics.average_precision(_judged_queries(data), ["query"], METRIC.relevant_tier)
    return rows.select(big("query").alias("query"),
                       six("average_precision").alias("average_precision"))


@query(
    "e6_map",
    S.using(
        f"SELECT {S.six('avg(ap)')} AS map FROM aps",
        "vecs", "gold", **_QVIEWS, p=_PLACED, aps=_AP,
    ),
)
def mean_average_precision(data):
    per_query = metrics.average_precision(
        _judged_queries(data), ["query"], METRIC.relevant_tier
    )
    return metrics.mean_average_precision(per_query).select(six("map").alias("map"))


# --- one query: the score ranking --------------------------------------------


def quality_sql(ranked: str, by: str = "") -> str:
    """The four rounded metrics and their composite per ``by`` of a judged view."""
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rounded = {
        "ndcg_at_10": _ndcg_sql(10),
        "ndcg_at_50": _ndcg_sql(50),
        "map": "coalesce(avg(CASE WHEN tier >= 3 THEN hits::DOUBLE / place::DOUBLE END), "
        "0.0::DOUBLE)",
        "precision_at_10": "sum((tier >= 3 AND place <= 10)::INT)::DOUBLE / 10.0::DOUBLE",
    }
    columns = ", ".join(f"{S.six(e)}::DOUBLE AS {n}" for n, e in rounded.items())
    total = " + ".join(
        ["0.0::DOUBLE"] + [f"{S.d(w)} * {n}" for n, w in METRIC.composite.items()]
    )
    return f"""SELECT *, {S.six(total)}::DOUBLE AS composite FROM (
      SELECT {head}{columns} FROM (
        SELECT *, sum((tier >= 3)::INT) OVER ({part}ORDER BY rank ROWS UNBOUNDED PRECEDING)
          AS hits FROM (
          SELECT *, row_number() OVER ({part}ORDER BY rank) AS place,
            row_number() OVER ({part}ORDER BY tier DESC, id) AS ideal FROM {ranked}))
      {group})"""


METRIC_NAMES = ("ndcg_at_10", "ndcg_at_50", "map", "precision_at_10", "composite")
_SIX_METRICS = ", ".join(f"{S.six(n)} AS {n}" for n in METRIC_NAMES)


@query(
    "e7_composite",
    S.using(f"SELECT {_SIX_METRICS} FROM q", "judged", q=quality_sql("judged")),
)
def composite(data):
    judged = judged_ranking(data).withColumn("query", F.lit(0))
    rows = metrics.quality(judged.select("query", "id", "rank", "tier"), ["query"], METRIC)
    return rows.select(*[six(n).alias(n) for n in METRIC_NAMES])


@query(
    "e8_impossible_in_top",
    S.using("SELECT id, rank FROM fullrank WHERE rank <= 100 AND impossible", "fullrank"),
)
def impossible_in_top(data):
    return metrics.impossible_in_top(ranked_top(data, 100, "raw"))


@query(
    "e9_off_target_in_top",
    S.using(
        """SELECT id, rank FROM fullrank WHERE rank <= 50 AND (impossible OR
        role_match <= 0.30::DOUBLE OR len(flags) > 0)""",
        "fullrank",
    ),
)
def off_target(data):
    return metrics.off_target_in_top(ranked_top(data, 50, "raw"), METRIC)


@query(
    "e10_strong_but_inactive",
    S.using(
        f"""SELECT id, tier::BIGINT AS tier, rank, {S.fix('availability', 3)} AS availability
        FROM judged WHERE tier >= 4 AND availability <= 0.85::DOUBLE""",
        "judged",
    ),
)
def inactive(data):
    rows = metrics.strong_but_inactive(metrics.judge(full_ranking(data), data.gold), METRIC)
    shown = F.call_function("format_number", F.col("availability"), F.lit("0.000"))
    return rows.select("id", big("tier").alias("tier"), "rank", shown.alias("availability"))


@query(
    "e11_traps_in_top",
    S.using(
        "SELECT id, tier::BIGINT AS tier, rank FROM judged WHERE tier <= 1 AND rank <= 50",
        "judged",
    ),
)
def traps(data):
    rows = metrics.traps_in_top(metrics.judge(ranked_top(data, 50, "raw"), data.gold), METRIC)
    return rows.select("id", big("tier").alias("tier"), "rank")


_COUNTS = {
    "ranked": "(SELECT count(*) FROM fullrank)",
    "impossible_in_top_100": "(SELECT count(*) FROM fullrank WHERE impossible AND rank <= 100)",
    "flagged_in_top_10": "(SELECT count(*) FROM fullrank WHERE len(flags) > 0 AND rank <= 10)",
    "flagged_in_top_50": "(SELECT count(*) FROM fullrank WHERE len(flags) > 0 AND rank <= 50)",
    "flagged_in_top_100": "(SELECT count(*) FROM fullrank WHERE len(flags) > 0 AND rank <= 100)",
    "off_target_in_top_50": "(SELECT count(*) FROM fullrank WHERE rank <= 50 AND (impossible OR "
    "role_match <= 0.30::DOUBLE OR len(flags) > 0))",
    "judged": "(SELECT count(*) FROM judged)",
    **{f"tier_{t}": f"(SELECT count(*) FROM judged WHERE tier = {t})" for t in range(6)},
    "traps_in_top_50": "(SELECT count(*) FROM judged WHERE tier <= 1 AND rank <= 50)",
    "strong_but_inactive": "(SELECT count(*) FROM judged WHERE tier >= 4 AND "
    "availability <= 0.85::DOUBLE)",
    "missing": "(SELECT count(*) FROM gold WHERE id NOT IN (SELECT id FROM fullrank))",
    "missing_relevant": "(SELECT count(*) FROM gold WHERE tier >= 3 AND id NOT IN "
    "(SELECT id FROM fullrank))",
    "labelled": "(SELECT count(*) FROM gold)",
}


@query(
    "e12_report",
    S.using(
        f"SELECT {', '.join(f'{e} AS {n}' for n, e in _COUNTS.items())}, {_SIX_METRICS} FROM q",
        "fullrank", "judged", q=quality_sql("judged"),
    ),
)
def report(data):
    row = evaluation(data)
    return row.select(*_COUNTS, *[six(n).alias(n) for n in METRIC_NAMES])


# --- sweeps --------------------------------------------------------------------


def _grid_sql(grid) -> dict[str, str]:
    """Views that score, rank and judge every configuration of a grid."""
    rows = ", ".join(
        f"({i}, {', '.join(S.d(c.weights[t]) for t in TERMS)}, {S.d(c.floor)})"
        for i, c in enumerate(grid)
    )
    names = ", ".join(["config_id", *[f"w_{t}" for t in TERMS], "floor"])
    base = " + ".join([S.d(0)] + [f"w_{t} * {t}" for t in TERMS])
    final = (
        f"CASE WHEN impossible THEN {S.d(0)} ELSE greatest({S.d(0)}, ({base}) - penalties) * "
        f"(floor + ({S.d(1)} - floor) * blend) * location END"
    )
    return {
        "grid": f"SELECT * FROM (VALUES {rows}) AS g({names})",
        "resc": f"SELECT config_id, id, impossible, {final} AS f FROM scored, grid",
        "rnk": "SELECT resc.*, gold.tier, row_number() OVER (PARTITION BY config_id "
               "ORDER BY f DESC, resc.id) AS rank FROM resc LEFT JOIN gold ON gold.id = resc.id",
        "jdg": "SELECT * FROM rnk WHERE tier IS NOT NULL",
        "q": quality_sql("jdg", "config_id"),
        "chk": "SELECT config_id, sum((impossible AND rank <= 100)::BIGINT)::BIGINT AS hp, "
               "sum(coalesce(tier <= 1 AND rank <= 50, false)::BIGINT)::BIGINT AS tr "
               "FROM rnk GROUP BY config_id",
    }


_HEADLINE = f"""SELECT q.config_id::BIGINT AS config_id, {_SIX_METRICS},
  hp AS impossible_in_top_100, tr AS traps_in_top_50 FROM q JOIN chk USING (config_id)"""


def _headline_query(name: str, grid):
    @query(name, S.using(_HEADLINE, "scored", "gold", **_grid_sql(grid)))
    def headline(data):
        rows = calibration(data, grid)
        return rows.select(
            big("config_id").alias("config_id"), *[six(n).alias(n) for n in METRIC_NAMES],
            "impossible_in_top_100", "traps_in_top_50",
        )

    return headline


BASE = SETTINGS.score
_headline_query("c1_full_grid", sweep.full_grid(BASE))
_headline_query("c4_floor_sweep", sweep.floor_grid(BASE))
_headline_query("c5_weight_sweep", sweep.coordinate_grid(BASE))
_headline_query("c9_locked", [sweep.locked(BASE)])


@query(
    "c2_renormalized",
    S.using(
        f"""SELECT id, {S.six('(' + ' + '.join(
            [S.d(0)] + [f'{S.d(w)} * {t}' for t, w in sweep.renormalize(
                {t: w * 3 for t, w in BASE.weights.items()}).items()]) + ')')} AS base_fit
        FROM feats""",
        "feats",
    ),
)
def renormalized(data):
    """Weights three times too large give the same fit once renormalised."""
    weights = sweep.renormalize({t: w * 3 for t, w in BASE.weights.items()})
    fit = sweep.base_fit(sweep.contributions(weights))
    return sweep_features(data).select("id", six(fit).alias("base_fit"))


@query(
    "c3_reweighted",
    S.using(
        f"""SELECT id, {S.six('(' + ' + '.join(
            [S.d(0)] + [f'{S.d(w)} * {t}' for t, w in sweep.set_weight(
                BASE.weights, 'built_ranking', 0.4).items()]) + ')')} AS base_fit
        FROM feats""",
        "feats",
    ),
)
def reweighted(data):
    weights = sweep.set_weight(BASE.weights, "built_ranking", 0.4)
    parts = sweep.contributions(weights)
    ordered = {t: parts[t] for t in weights}
    return sweep_features(data).select("id", six(sweep.base_fit(ordered)).alias("base_fit"))


_LOCKED = BASE.with_floor(sweep.LOCKED_FLOOR)
_STABILITY = [sweep.baseline(_LOCKED), *sweep.stability_grid(_LOCKED)]
_ABLATION = [sweep.baseline(_LOCKED), *sweep.ablation_grid(_LOCKED)]
_DELTA = "composite - (SELECT composite FROM q WHERE config_id = 0)"


@query(
    "c6_stability",
    S.using(
        f"SELECT {S.six(f'max(abs({_DELTA}))')} AS worst_swing FROM q",
        "scored", "gold", **_grid_sql(_STABILITY),
    ),
)
def stability(data):
    rows = sweep.with_delta(calibration(data, _STABILITY), 0)
    return sweep.worst_swing(rows).select(six("worst_swing").alias("worst_swing"))


@query(
    "c7_ablation",
    S.using(
        f"SELECT config_id::BIGINT AS config_id, {S.six(_DELTA)} AS delta FROM q",
        "scored", "gold", **_grid_sql(_ABLATION),
    ),
)
def ablation(data):
    rows = sweep.with_delta(calibration(data, _ABLATION), 0)
    return rows.select(big("config_id").alias("config_id"), six("delta").alias("delta"))


@query(
    "c8_tracked_ranks",
    S.using(
        """SELECT config_id::BIGINT AS config_id, buried.id, coalesce(rnk.rank, -1) AS rank
        FROM (SELECT gold.id FROM gold LEFT JOIN fullrank ON gold.id = fullrank.id
          WHERE gold.tier >= 4 AND coalesce(rank, 1000000000) > 100) buried
        CROSS JOIN (SELECT config_id FROM grid) g
        LEFT JOIN rnk USING (config_id, id)""",
        "scored", "gold", "fullrank", **_grid_sql(sweep.floor_grid(BASE)),
    ),
)
def tracked(data):
    grid = sweep.floor_grid(BASE)
    ranked = sweep.rank_configs(sweep.rescore(durable(sweep_features(data)), grid))
    buried = sweep.buried(full_ranking(data), data.gold, METRIC)
    rows = sweep.tracked_ranks(ranked, buried, grid)
    return rows.select(big("config_id").alias("config_id"), "id", "rank")


@query(
    "e9_restricted_ranking",
    S.using(
        """SELECT id, row_number() OVER (ORDER BY final DESC, id) AS rank FROM scored
        WHERE id IN (SELECT id FROM gold)""",
        "scored", "gold",
    ),
)
def restricted(data):
    """Evaluation path over a given id set: the labelled part of the shortlist."""
    ids = restrict(shortlist(data), data.gold)
    return full_ranking(data, ids).select("id", "rank")
