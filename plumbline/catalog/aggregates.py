"""Aggregations (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.operators import metrics, summary
from plumbline.operators.membership import with_similarity
from plumbline.operators.shortlist import mark_targets, threshold_scan
from plumbline.plans.jobs import full_ranking, ranked_top, shortlist

POOL_GRID = tuple(round(-0.3 + 0.05 * i, 3) for i in range(15))
PRICE_GRID = tuple(float(5000 * i) for i in range(1, 16))


@query(
    "a1_branch_counts",
    S.using(
        f"""SELECT CASE WHEN is_target AND cosine >= {S.d(S.THRESHOLD)} THEN 'both'
        WHEN is_target THEN 'archetype' ELSE 'similarity' END AS branch, count(*) AS n
        FROM matched GROUP BY 1""",
        "matched",
    ),
)
def branch_counts(data):
    return summary.branch_counts(shortlist(data))


def _scan_sql(grid, source: str, target: str, value: str) -> str:
    listed = ", ".join(S.d(t) for t in grid)
    return f"""SELECT {S.six('t')} AS threshold, sum(({value} >= t)::BIGINT)::BIGINT
      AS by_similarity, sum(({target} OR {value} >= t)::BIGINT)::BIGINT AS by_union,
      (sum(({target} OR {value} >= t)::BIGINT) - sum(({target})::BIGINT))::BIGINT AS over_targets
    FROM {source}, (SELECT unnest([{listed}]) AS t) GROUP BY t"""


@query(
    "a2_threshold_scan",
    S.using(_scan_sql(POOL_GRID, "joined", "is_target", "cosine"), "joined"),
)
def pool_scan(data):
    marked = with_similarity(
        mark_targets(data.pool.select("id", "profile"), data.settings.filter), data.similarity
    )
    scanned = threshold_scan(marked, POOL_GRID)
    return scanned.withColumn("threshold", six("threshold"))


@query(
    "a2_threshold_scan_lines",
    _scan_sql(PRICE_GRID, "lineitem", "(l_returnflag = 'R')", "l_extendedprice"),
)
def line_scan(data):
    marked = data.table("lineitem").select(
        (F.col("l_returnflag") == "R").alias("is_target"), "l_extendedprice"
    )
    scanned = threshold_scan(marked, PRICE_GRID, "l_extendedprice")
    return scanned.withColumn("threshold", six("threshold"))


@query(
    "a3_histogram",
    S.using(
        f"""SELECT role AS value, count(*) AS n, {S.six('count(*)::DOUBLE / t::DOUBLE')} AS share,
        round_even(40.0::DOUBLE * count(*) / t, 0)::BIGINT AS bar
        FROM signals, (SELECT count(*) AS t FROM signals) GROUP BY role, t""",
        "signals",
    ),
)
def histogram(data):
    rows = summary.histogram(data.signals, "role_archetype")
    return rows.select("value", "n", six("share").alias("share"), big("bar").alias("bar"))


@query(
    "a4_flag_histogram",
    S.using(
        f"""SELECT value, count(*) AS n, {S.six('count(*)::DOUBLE / t::DOUBLE')} AS share FROM (
        SELECT unnest(flags) AS value FROM signals), (SELECT count(*) AS t FROM signals)
        GROUP BY value, t""",
        "signals",
    ),
)
def flag_histogram(data):
    rows = summary.member_histogram(data.signals, "disqualifier_flags")
    return rows.withColumn("share", six("share"))


@query(
    "a5_true_rate",
    S.using(
        f"""SELECT sum(built::BIGINT)::BIGINT AS n_true, count(*) AS n,
        {S.six('sum(built::INT)::DOUBLE / count(*)::DOUBLE')} AS rate FROM signals""",
        "signals",
    ),
)
def built_rate(data):
    rows = summary.true_rate(data.signals, F.col("built_ranking_or_search"))
    return rows.withColumn("rate", six("rate"))


@query(
    "a6_reason_histogram",
    S.using(
        """SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM flagged)
        GROUP BY reason""",
        "flagged",
    ),
)
def reasons(data):
    return summary.reason_histogram(data.flagged)


@query(
    "a6_first_flagged",
    S.using(
        """SELECT id, array_to_string(reasons, '|') AS reasons FROM flagged ORDER BY id LIMIT 5""",
        "flagged",
    ),
)
def first_flagged(data):
    return summary.first_ids(data.flagged).select("id", joined("reasons").alias("reasons"))


@query(
    "a7_scan_counts",
    S.using(
        """SELECT (SELECT count(*) FROM docs) AS total, (SELECT count(*) FROM flagged)
        AS flagged""",
        "docs", "flagged",
    ),
)
def scan_counts(data):
    return summary.scan_counts(data.pool, data.flagged)


@query(
    "a8_tier_histogram",
    S.using(
        """SELECT t::BIGINT AS tier, count(judged.id) AS n FROM (SELECT unnest(range(0, 6)) AS t)
        LEFT JOIN judged ON judged.tier = t GROUP BY t""",
        "judged",
    ),
)
def tier_histogram(data):
    judged = metrics.judge(shortlist(data), data.gold)
    rows = metrics.tier_histogram(judged, data.settings.metric)
    return rows.select(big("tier").alias("tier"), "n")


@query(
    "a9_top_summary",
    S.using(
        f"""SELECT count(*) AS n, sum(impossible::BIGINT)::BIGINT AS impossible,
        sum((len(flags) > 0)::BIGINT)::BIGINT AS flagged, {S.six('min(availability)')}
        AS lowest_availability, {S.six('max(availability)')} AS highest_availability
        FROM fullrank WHERE rank <= 100""",
        "fullrank",
    ),
)
def top_summary(data):
    rows = summary.top_summary(ranked_top(data, 100, "raw"))
    return rows.withColumns(
        {n: six(n) for n in ("lowest_availability", "highest_availability")}
    )


@query(
    "a10_flagged_in_top",
    S.using(
        "SELECT "
        + ", ".join(
            f"sum((len(flags) > 0 AND rank <= {k})::BIGINT)::BIGINT AS flagged_in_top_{k}"
            for k in (10, 50, 100)
        )
        + " FROM fullrank",
        "fullrank",
    ),
)
def flagged_in_top(data):
    return metrics.flagged_in_top(ranked_top(data, 100, "raw"))


@query(
    "a11_tier_ranks",
    S.using("SELECT tier::BIGINT AS tier, rank FROM judged", "judged"),
)
def tier_ranks(data):
    rows = metrics.tier_ranks(metrics.judge(full_ranking(data), data.gold))
    return rows.select(big("tier").alias("tier"), "rank")


@query(
    "a13_duplicate_texts",
    """SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT lower(trim(text, ' ' || chr(9) ||
      chr(10) || chr(13))) AS k, count(*) AS n FROM documents GROUP BY 1)""",
)
def duplicate_texts(data):
    return summary.duplicate_count(data.table("documents"), "text").select(
        big("duplicates").alias("duplicates")
    )


@query(
    "a16_coverage",
    S.using(
        """SELECT 'vectors' AS artifact, count(*) AS n FROM vecs UNION ALL
        SELECT 'signals', count(*) FROM signals UNION ALL
        SELECT 'flags', count(*) FROM flagged UNION ALL SELECT 'texts', count(*) FROM texts""",
        "vecs", "signals", "flagged", "texts",
    ),
)
def coverage(data):
    return summary.coverage(
        vectors=data.vectors, signals=data.signals, flags=data.flagged, texts=data.texts
    )
