"""Ordering, ranking and sampling positions (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.config import TERM_WEIGHTS, TERMS
from plumbline.functions.grounding import leading_terms
from plumbline.operators import metrics, ordering, sweep
from plumbline.operators.durable import durable
from plumbline.operators.sampling import priority_sample
from plumbline.operators.scored import order_by
from plumbline.plans.jobs import full_ranking, scored_pool, shortlist


@query("w1_rank_formatted", S.using("SELECT id, rank, score FROM ranked", "ranked"))
def rank_formatted(data):
    scored = scored_pool(data).select("id", "score", "score_value")
    return ordering.positions(scored, order_by("formatted")).select("id", "rank", "score")


@query(
    "w1_rank_raw",
    S.using(f"SELECT id, rank, {S.six('final')} AS final FROM fullrank", "fullrank"),
)
def rank_raw(data):
    return full_ranking(data).select("id", "rank", six("final").alias("final"))


@query(
    "w1_rank_orders",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders""",
)
def rank_orders(data):
    rows = data.table("orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return ordering.positions(rows, order).select("o_orderkey", "rank")


@query(
    "w1_rank_lines_by_flag",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_returnflag,
      row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey,
        l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rank FROM lineitem""",
)
def rank_lines(data):
    """Three groups hold all rows, so each spans many range partitions."""
    rows = data.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_returnflag", "l_extendedprice",
    )
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(),
             F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc(),
             F.col("l_shipdate").asc(), F.col("l_quantity").asc()]
    ranked = ordering.positions(rows, order, ["l_returnflag"])
    return ranked.select(
        "l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_partkey", "l_returnflag",
        "rank",
    )


@query(
    "w2_top_n",
    S.using("SELECT id, rank, score FROM ranked WHERE rank <= 100", "ranked"),
)
def top_n(data):
    top = ordering.top_n(scored_pool(data), order_by("formatted"), 100)
    return ordering.require_rows(durable(top), 100).select("id", "rank", "score")


@query(
    "w3_first_per_key",
    """SELECT user_id::VARCHAR AS user, min(event_id) AS event_id FROM events GROUP BY user_id""",
)
def first_per_key(data):
    rows = data.table("events").select(F.col("user_id").cast("string").alias("user"), "event_id")
    return ordering.first_per_key(rows, "user", [F.col("event_id").asc()])


@query(
    "w4_last_per_key",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
    FROM events GROUP BY user_id""",
)
def last_per_key(data):
    rows = data.table("events").select("user_id", "event_id", "event_type")
    return ordering.last_per_key(rows, "user_id", F.col("event_id"))


_TERM_ROWS = ", ".join(
    f"{{'v': -({S.d(TERM_WEIGHTS[t])} * {t}), 'i': {i}, 'n': '{t}'}}" for i, t in enumerate(TERMS)
)


@query(
    "w5_leading_terms",
    S.using(
        f"""SELECT id, array_to_string(list_transform(list_filter(list_sort([{_TERM_ROWS}])[1:3],
        lambda e: e.v < 0), lambda e: e.n), '|') AS leading FROM feats""",
        "feats",
    ),
)
def leading(data):
    scored = scored_pool(data)
    parts = {t: F.col("contributions")[t] for t in TERMS}
    names = leading_terms(parts, data.settings.text.leading_terms)
    return scored.select("id", joined(names).alias("leading"))


@query(
    "w6_running_precision",
    S.using(
        f"""SELECT id, place, hits, {S.six('hits::DOUBLE / place::DOUBLE')} AS precision FROM (
        SELECT id, row_number() OVER w AS place,
          (sum((tier >= 3)::INT) OVER w)::BIGINT AS hits FROM judged
        WINDOW w AS (ORDER BY rank ROWS UNBOUNDED PRECEDING))""",
        "judged",
    ),
)
def running(data):
    judged = metrics.judge(full_ranking(data), data.gold).withColumn("query", F.lit(0))
    rows = metrics.running_precision(
        judged.select("query", "id", "rank", "tier"), ["query"], data.settings.metric.relevant_tier
    )
    return rows.select("id", "place", "hits", six("precision").alias("precision"))


@query(
    "w7_ideal_order",
    S.using(
        """SELECT id, tier::BIGINT AS tier, row_number() OVER (ORDER BY tier DESC, id) AS place
        FROM judged""",
        "judged",
    ),
)
def ideal(data):
    judged = metrics.judge(full_ranking(data), data.gold).select("id", "tier")
    order = [F.col("tier").desc(), F.col("id").asc()]
    return ordering.positions(judged, order, rank="place").select(
        "id", big("tier").alias("tier"), "place"
    )


@query(
    "w8_stride",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)
      AS rank, count(*) OVER () AS n FROM orders),
    b AS (SELECT *, floor(n * 0.25)::BIGINT AS lo, floor(n * 0.60)::BIGINT AS hi FROM r),
    s AS (SELECT *, greatest(1, (hi - lo) // 25) AS step FROM b)
    SELECT o_orderkey, rank FROM s WHERE rank - 1 >= lo AND rank - 1 < hi
      AND (rank - 1 - lo) % step = 0 AND (rank - 1 - lo) // step < 25""",
)
def stride(data):
    rows = data.table("orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    ranked = ordering.positions(rows, order)
    total = data.table("orders").agg(F.count(F.lit(1))).scalar()
    numbered = ranked.withColumn("_total", total)
    return ordering.stride(numbered, F.col("_total"), 0.25, 0.60, 25).select("o_orderkey", "rank")


@query(
    "w9_lower_quantile",
    f"""SELECT {S.six('v')} AS quantile FROM (SELECT o_totalprice AS v, row_number() OVER
      (ORDER BY o_totalprice) AS rank, count(*) OVER () AS n FROM orders)
    WHERE rank = floor(0.3::DOUBLE * (n - 1)) + 1""",
)
def quantile(data):
    found = ordering.lower_quantile(data.table("orders"), "o_totalprice", 0.3)
    return found.select(six("quantile").alias("quantile"))


@query(
    "w11_bottom_n",
    S.using(
        """SELECT id, row_number() OVER (ORDER BY rank DESC) AS place FROM fullrank
        ORDER BY rank DESC LIMIT 10""",
        "fullrank",
    ),
)
def bottom(data):
    last = ordering.top_n(scored_pool(data).select("id", "final"),
                          [F.col("final").asc(), F.col("id").desc()], 10, "place")
    return last.select("id", "place")


@query(
    "w12_buried",
    S.using(
        """SELECT gold.id, rank, tier::BIGINT AS tier FROM gold LEFT JOIN fullrank
        ON gold.id = fullrank.id WHERE tier >= 4 AND coalesce(rank, 1000000000) > 100""",
        "gold", "fullrank",
    ),
)
def buried(data):
    rows = sweep.buried(full_ranking(data), data.gold, data.settings.metric)
    return rows.orderBy(F.col("rank").asc_nulls_last(), "id").select(
        "id", "rank", big("tier").alias("tier")
    )


@query(
    "w13_priority_sample",
    S.using(
        """SELECT row_number() OVER (ORDER BY tier, place, id) AS position, id,
          CASE WHEN tier = 0 THEN 'chosen' ELSE 'ranked' END AS via FROM (
          SELECT id, min(tier) AS tier, arg_min(place, tier) AS place FROM (
            SELECT id, 0 AS tier, row_number() OVER (ORDER BY id) AS place FROM flagged
            UNION ALL SELECT id, 1, rank FROM fullrank)
          WHERE id IN (SELECT id FROM matched) GROUP BY id)
        ORDER BY tier, place, id LIMIT 60""",
        "flagged", "fullrank", "matched",
    ),
)
def sample(data):
    chosen = ordering.positions(data.flagged.select("id"), [F.col("id").asc()], rank="place")
    return priority_sample(chosen, full_ranking(data), shortlist(data), 60)
