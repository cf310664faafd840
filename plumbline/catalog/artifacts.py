"""Files of a run: what their readers and writers do to the content (S*, Q1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, query, six
from plumbline.catalog.cleaning import CLEAN_SIGNALS, typed_signals
from plumbline.functions.cleaning import coerce_signal
from plumbline.functions.vector import norm
from plumbline.operators.durable import ensure_checkpoint_dir
from plumbline.operators.ordering import last_per_key
from plumbline.plans.dataset import SETTINGS
from plumbline.sources import jsonl, tables


@query(
    "s2_line_counts",
    f"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda line:
      {S.sq('line')} <> ''))::BIGINT AS n FROM documents""",
)
def line_counts(data):
    lines = F.filter(F.split("text", "\n"), jsonl.not_blank)
    return data.table("documents").select("doc_id", big(F.size(lines)).alias("n"))


@query(
    "s7_flag_ids",
    """SELECT DISTINCT 'U' || user_id AS id FROM events WHERE event_type <> 'error'""",
)
def flag_ids(data):
    """Flag objects of one id each; those in a list hold no ids."""
    flag = F.concat(F.lit('{"U'), F.col("user_id").cast("string"), F.lit('": '), F.col("props"),
                    F.lit("}"))
    listed = F.concat(F.lit("["), flag, F.lit("]"))
    text = F.when(F.col("event_type") == "error", listed).otherwise(flag)
    rows = data.table("events").select(F.explode(jsonl.flag_ids(text)).alias("id"))
    return rows.distinct()


@query(
    "s11_appended_log",
    f"""WITH c AS ({CLEAN_SIGNALS}), b AS (SELECT id, (event_type = 'click')::INT AS batch,
      arg_max(role, event_id) AS role, arg_max(product, event_id) AS product FROM c
      GROUP BY ALL) SELECT id, arg_max(role, batch) AS role,
      {S.six('arg_max(product, batch)')} AS product FROM b GROUP BY id""",
)
def appended_log(data):
    """Two batches appended to one log: the later one wins."""
    ensure_checkpoint_dir(data.spark)
    path = f"{data.spark.sparkContext.getCheckpointDir()}/log-{uuid.uuid4().hex}"
    typed = coerce_signal(F.col("record"))
    names = ("id", "role_archetype", "product_vs_services")
    rows = typed_signals(data).select(
        "event_id", "event_type", *[typed[n].alias(n) for n in names]
    )
    for batch in (F.col("event_type") != "click", F.col("event_type") == "click"):
        latest = last_per_key(rows.filter(batch), "id", F.col("event_id"))
        jsonl.append_records(latest.select(*names), path)
    return jsonl.read_signals(data.spark, path).select(
        "id", F.col("role_archetype").alias("role"), six("product_vs_services").alias("product")
    )


@query(
    "s12_reference_records",
    f"""SELECT vec_id, label <> 0 AS has_vector, CASE WHEN label <> 0 THEN len(embedding)
      ELSE 0 END::BIGINT AS n, CASE WHEN label <> 0 THEN {S.six(
          'sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} END AS length,
      'label ' || label AS ideal_text FROM embeddings""",
)
def reference_records(data):
    """Reference records as JSON texts; a record may lack its vector."""
    vector = F.when(F.col("label") != 0, F.col("embedding").cast("array<double>")).otherwise(
        F.array().cast("array<double>")
    )
    text = F.to_json(
        F.struct(
            F.concat(F.lit(" label  "), F.col("label").cast("string"), F.lit(" ")).alias(
                "ideal_text"),
            vector.alias("reference_embedding"),
        )
    )
    rows = data.table("embeddings").select("vec_id", F.try_parse_json(text).alias("r"))
    fields = tables.reference_fields(F.col("r"))
    found = rows.select("vec_id", *[fields[n].alias(n) for n in ("ideal_text", "embedding")])
    some = F.size("embedding") > 0
    return found.select(
        "vec_id", some.alias("has_vector"), big(F.size("embedding")).alias("n"),
        F.when(some, six(norm(F.col("embedding")))).alias("length"), "ideal_text",
    )


def _gold_sheet(data):
    """Orders as a gold sheet: several labels for an id, some rows without one."""
    tier = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(
        F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1))
    )
    return data.table("orders").select(
        F.concat(F.lit(" C"), F.col("o_custkey").cast("string")).alias("candidate_id"),
        tier.alias("tier"), F.concat("o_orderpriority", F.lit(" ")).alias("note"),
        F.col("o_orderkey").alias("_line"),
    )


@query(
    "s15_gold_labels",
    """SELECT 'C' || o_custkey AS id, arg_max(substring(o_orderpriority, 1, 1), o_orderkey)::BIGINT
      AS tier, arg_max(trim(o_orderpriority), o_orderkey) AS note FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY o_custkey""",
)
def gold_labels(data):
    found = tables.last_labels(tables.labelled_rows(_gold_sheet(data), "candidate_id"))
    return found.select("id", big("tier").alias("tier"), "note")


@query(
    "s15_bad_tiers",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 'high' ELSE '9' END AS tier
    FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND o_orderstatus <> 'P'""",
)
def bad_tiers(data):
    """Labels that stop the evaluation: a word, and a number beyond the scale."""
    note = F.trim("note")
    spoilt = F.when((note == "2-HIGH") & (F.trim("tier") != ""), "high").when(
        (note == "3-MEDIUM") & (F.trim("tier") != ""), " 9"
    ).otherwise(F.col("tier"))
    rows = tables.labelled_rows(_gold_sheet(data).withColumn("tier", spoilt), "candidate_id")
    return tables.bad_tiers(rows, SETTINGS.metric).select(
        F.col("_line").alias("o_orderkey"), F.col("tier_text").alias("tier")
    )


@query(
    "s17_report_lines",
    """SELECT '{"late":' || sum((o_orderpriority = '5-LOW')::BIGINT)::BIGINT || ',"orders":' ||
      count(*) || ',"status":"' || o_orderstatus || '"}' AS line FROM orders
    GROUP BY o_orderstatus""",
)
def report_lines(data):
    rows = data.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("late"),
    )
    return rows.select(tables.report_line(rows.columns).alias("line"))


@query(
    "q1_column_counts",
    """SELECT 'column_count' AS "check", o_orderkey::VARCHAR AS "row", '4' AS detail FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def column_counts(data):
    """Output lines of four fields, with a quoted comma, and of three or five."""
    fields = [F.col("o_orderkey").cast("string"), F.lit("1"), F.lit("0.5")]
    kind = F.col("o_orderpriority")
    line = (
        F.when(kind == "1-URGENT", F.concat_ws(",", *fields))
        .when(kind == "5-LOW", F.concat_ws(",", *fields, F.lit("a"), F.lit("b")))
        .when(kind == "2-HIGH", F.concat_ws(",", *fields, F.lit("")))
        .otherwise(F.concat_ws(",", *fields, F.lit('"a, ""b"""')))
    )
    parsed = F.from_csv(line, tables.FIELDS, tables.FIELD_OPTIONS)
    return tables.uneven_rows(data.table("orders").select(parsed.alias("r")).select("r.*"))
