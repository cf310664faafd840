"""Output constraint checks (Q*), over the orders written as a flawed ranked output."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import query
from plumbline.functions.scalar import fixed
from plumbline.operators import checks
from plumbline.operators.durable import durable
from plumbline.plans.jobs import TOP_N, ranked_output

PATTERN = r"^[A-Z]+_[0-9]{7,}$"
#: Rows that the output should have; the orders are fewer or more.
EXPECTED = 10_000


def _rows(data):
    """Text columns id, rank, score with every kind of flaw somewhere."""
    key, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def number(column):
        return F.lpad(column.cast("string"), 12, "0")

    name = (
        F.when((status == "F") & (priority == "1-URGENT"), F.concat(F.lit("ord_"), number(key)))
        .when((status == "P") & (priority == "5-LOW"), F.lit("  "))
        .when(priority == "3-MEDIUM", F.concat(F.lit("ORD_"), number(F.col("o_custkey"))))
        .otherwise(F.concat(F.lit("ORD_"), number(key)))
    )
    place = (key + 1).cast("string")
    rank = (
        F.when(priority == "4-NOT SPECIFIED", F.concat(F.lit("0"), place))
        .when((priority == "2-HIGH") & (status == "O"), (F.col("o_custkey") + 1).cast("string"))
        .otherwise(place)
    )
    score = F.when((status == "P") & (priority == "1-URGENT"), "n/a").otherwise(
        fixed(F.floor(F.col("o_totalprice") / 1000.0))
    )
    return data.table("orders").select(
        name.alias("id"), rank.alias("rank"), score.alias("score")
    )


_SQL_ROWS = f"""SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
    THEN 'ord_' || lpad(o_orderkey::VARCHAR, 12, '0')
    WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '  '
    WHEN o_orderpriority = '3-MEDIUM' THEN 'ORD_' || lpad(o_custkey::VARCHAR, 12, '0')
    ELSE 'ORD_' || lpad(o_orderkey::VARCHAR, 12, '0') END AS id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '0' || (o_orderkey + 1)
    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN (o_custkey + 1)::VARCHAR
    ELSE (o_orderkey + 1)::VARCHAR END AS rank,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'n/a'
    ELSE {S.six('floor(o_totalprice / 1000.0::DOUBLE)')} END AS score FROM orders"""
_SQL = {
    "rows": _SQL_ROWS,
    "total": f"SELECT {EXPECTED} AS n",
    "typed": "SELECT trim(id) AS id, CASE WHEN rank NOT LIKE '0%' THEN rank::BIGINT END AS r, "
             "try_cast(score AS DOUBLE) AS s, score FROM rows",
    "near": "SELECT r, s, id, lead(r) OVER w AS r2, lead(s) OVER w AS s2, lead(id) OVER w AS id2 "
            "FROM typed WHERE r IS NOT NULL AND s IS NOT NULL AND id <> '' "
            "WINDOW w AS (ORDER BY r, id)",
    "v": f"""SELECT 'row_count' AS "check", 1 AS n FROM total
        WHERE n <> (SELECT count(*) FROM rows)
      UNION ALL SELECT 'id_missing', count(*) FROM typed WHERE id = ''
      UNION ALL SELECT 'id_pattern', count(*) FROM typed WHERE id <> ''
        AND NOT regexp_matches(id, '{PATTERN}')
      UNION ALL SELECT 'id_duplicate', count(*) FROM (SELECT id FROM typed
        WHERE regexp_matches(id, '{PATTERN}') GROUP BY id HAVING count(*) > 1)
      UNION ALL SELECT 'rank_format', count(*) FROM typed WHERE r IS NULL
      UNION ALL SELECT 'rank_range', count(*) FROM typed, total WHERE r < 1 OR r > n
      UNION ALL SELECT 'rank_duplicate', count(*) FROM (SELECT r FROM typed, total
        WHERE r BETWEEN 1 AND n GROUP BY r HAVING count(*) > 1)
      UNION ALL SELECT 'rank_missing', count(*) FROM (SELECT unnest(range(1, n + 1)) AS x
        FROM total) WHERE x NOT IN (SELECT r FROM typed WHERE r IS NOT NULL)
      UNION ALL SELECT 'score_format', count(*) FROM typed WHERE s IS NULL
      UNION ALL SELECT 'score_order', count(*) FROM near WHERE s < s2
      UNION ALL SELECT 'tie_order', count(*) FROM near WHERE s = s2 AND id > id2""",
}


def _count(found):
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def _only(*names: str) -> str:
    listed = S.quoted(names)
    return S.using(f'SELECT * FROM v WHERE n > 0 AND "check" IN ({listed})', **_SQL)


@query("q2_row_count", _only("row_count"))
def row_count(data):
    rows = _rows(data)
    return _count(checks.row_count(rows, EXPECTED))


@query("q3_ids", _only("id_missing", "id_pattern", "id_duplicate"))
def ids(data):
    rows = _rows(data)
    found = checks.id_missing(rows).unionByName(checks.id_pattern(rows, PATTERN))
    return _count(found.unionByName(checks.id_duplicates(rows, PATTERN)))


@query("q4_ranks", _only("rank_format", "rank_range", "rank_duplicate", "rank_missing"))
def ranks(data):
    rows = _rows(data)
    found = checks.rank_format(rows).unionByName(checks.rank_range(rows, EXPECTED))
    found = found.unionByName(checks.rank_duplicates(rows, EXPECTED))
    return _count(found.unionByName(checks.rank_missing(rows, EXPECTED)))


@query("q5_scores", _only("score_format"))
def scores(data):
    return _count(checks.score_format(_rows(data)))


@query("q6_order", _only("score_order", "tie_order"))
def order(data):
    return _count(checks.score_order(_rows(data)))


@query("q7_all_violations", S.using("SELECT * FROM v WHERE n > 0", **_SQL))
def all_violations(data):
    return _count(checks.output_violations(_rows(data), EXPECTED, PATTERN))


@query("q7_ranked_output_is_valid", """SELECT '' AS "check", 0::BIGINT AS n WHERE false""")
def own_output(data):
    """The ranked output itself breaks no constraint and has all its rows."""
    rows = durable(ranked_output(data, TOP_N)).select(
        "id", F.col("rank").cast("string").alias("rank"), "score")
    return _count(checks.output_violations(rows, TOP_N, PATTERN))
