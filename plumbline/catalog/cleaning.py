"""Cleaning of generated text (D*) and logs (S1, S9, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.config import DEFAULT_ROLE, ROLES
from plumbline.functions import cleaning as cl
from plumbline.functions.scalar import squeeze
from plumbline.operators.checks import rubric_issues
from plumbline.plans.dataset import record_id
from plumbline.sources.jsonl import latest_records


def _replies(data):
    """Events as model replies: plain, fenced, in prose, cut off, or no JSON at all."""
    props = F.col("props")
    reply = (
        F.when(F.col("event_type") == "view", props)
        .when(F.col("event_type") == "click",
              F.concat(F.lit("```json\n"), props, F.lit("\n```\nDone.")))
        .when(F.col("event_type") == "signup",
              F.concat(F.lit('Sure {see "below": '), props, F.lit("} - that is all }")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Here it is: "), props,
                                                          F.lit(" and {more}")))
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    return data.table("events").select("event_id", "event_type", reply.alias("reply"))


_REPLY = """SELECT event_id, event_type, props, CASE event_type WHEN 'view' THEN props
  WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 'signup' THEN 'Sure {see "below": ' || props || '} - that is all }'
  WHEN 'purchase' THEN 'Here it is: ' || props || ' and {more}'
  ELSE substring(props, 1, length(props) - 1) END AS reply FROM events"""


@query(
    "s1_json_lines",
    f"""WITH r AS ({_REPLY}) SELECT event_type, count(*) AS n,
      sum(json_valid(reply)::BIGINT)::BIGINT AS parsed,
      sum((NOT json_valid(reply))::BIGINT)::BIGINT AS rejected FROM r GROUP BY event_type""",
)
def json_lines(data):
    valid = cl.is_json(F.col("reply"))
    return _replies(data).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("parsed"),
        F.count_if(~valid).alias("rejected"),
    )


@query(
    "d1_strip_fence",
    f"""WITH r AS ({_REPLY}) SELECT event_id, CASE WHEN event_type = 'click' THEN props
      ELSE reply END AS body FROM r""",
)
def fence(data):
    return _replies(data).select("event_id", cl.strip_fence(F.col("reply")).alias("body"))


@query(
    "d2_first_balanced",
    f"""WITH r AS ({_REPLY}) SELECT event_id, CASE event_type WHEN 'error' THEN NULL
      WHEN 'signup' THEN substring(reply, 6, length(reply) - 21)
      ELSE props END AS found FROM r""",
)
def balanced(data):
    return _replies(data).select("event_id", cl.first_balanced(F.col("reply")).alias("found"))


@query(
    "d3_parse_with_fallback",
    f"""WITH r AS ({_REPLY}) SELECT event_id, CASE WHEN event_type IN ('view', 'click',
      'purchase') THEN json_extract_string(props, '$.k')::BIGINT END AS k,
      event_type IN ('error', 'signup') AS rejected FROM r""",
)
def parsed(data):
    rows = cl.with_json_text(_replies(data), "reply")
    return rows.select(
        "event_id", cl.field(F.try_parse_json("json"), "k", "bigint").alias("k"),
        F.col("json").isNull().alias("rejected"),
    )


_SHAPE = """CASE event_type WHEN 'view' THEN '[' || props || ', ' || props || ']'
  WHEN 'click' THEN '{"note": "x", "results": [' || props || '], "again": [1, 2, 3]}'
  WHEN 'signup' THEN '{"k": 1, "role_archetype": "x"}' WHEN 'purchase' THEN '{"k": 5}'
  ELSE '7' END"""


@query(
    "d4_unwrap",
    """SELECT event_type, (count(*) * CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1
      WHEN 'signup' THEN 1 ELSE 0 END)::BIGINT AS records,
      sum(CASE WHEN event_type = 'view' THEN 2 * k WHEN event_type = 'click' THEN k
      WHEN event_type = 'signup' THEN 1 ELSE 0 END)::BIGINT AS total
    FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
    GROUP BY event_type""",
)
def unwrapped(data):
    replies = data.table("events").select("event_type", F.expr(_SHAPE).alias("t"))
    listed = replies.withColumn("r", cl.records(F.col("t"), ["k", "role_archetype"]))
    totals = F.aggregate(
        F.transform("r", lambda x: F.coalesce(cl.field(x, "k", "bigint"), F.lit(0).cast(
            "bigint"))),
        F.lit(0).cast("bigint"), lambda t, x: t + x,
    )
    return listed.groupBy("event_type").agg(
        F.sum(F.size("r")).cast("bigint").alias("records"), F.sum(totals).alias("total")
    )


# Events as signal log lines; labels arrive in many spellings, some unknown.
_LABELS = {
    "view": ("ML-Engineer", "ml_engineer"),
    "click": (" Data/Scientist ", "data_scientist"),
    "signup": ("recsys  search", "recsys_search"),
    "purchase": ("astronaut", DEFAULT_ROLE),
    "error": ("NON TECH", "non_tech"),
}


def _log_lines(data):
    kind = F.col("event_type")
    label = F.lit(None).cast("string")
    for name, (raw, _) in _LABELS.items():
        label = F.when(kind == name, raw).otherwise(label)
    record = F.to_json(
        F.struct(
            F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" ")).alias("id"),
            label.alias("role_archetype"),
            (F.col("value") / F.lit(50.0)).alias("product_vs_services"),
            (F.col("value") / F.lit(20.0)).cast("string").alias("seniority_band_fit"),
            F.when(kind == "view", "Yes").otherwise("nope").alias("built_ranking_or_search"),
            F.when(kind == "click", F.array(F.lit("Job-Hopper"), F.lit("cv primary"),
                                            F.lit("job_hopper"), F.lit("lazy"))).alias(
                "disqualifier_flags"),
        )
    )
    broken = F.when(kind == "error", F.concat(record, F.lit("}"))).otherwise(record)
    return data.table("events").select("event_id", "user_id", kind, "value",
                                       broken.alias("line"))


def typed_signals(data):
    return cl.object_rows(_log_lines(data), "line")


_CASE_ROLE = " ".join(f"WHEN '{n}' THEN '{clean}'" for n, (_, clean) in _LABELS.items())
CLEAN_SIGNALS = f"""SELECT event_id, user_id, event_type, 'U' || user_id AS id,
  CASE event_type {_CASE_ROLE} END AS role,
  {S.clip('value / 50.0::DOUBLE')} AS product, {S.clip('value / 20.0::DOUBLE')} AS seniority,
  event_type = 'view' AS built,
  CASE WHEN event_type = 'click' THEN 'cv_primary|job_hopper' ELSE '' END AS flags
FROM events WHERE event_type <> 'error'"""


@query(
    "d5_coerce_record",
    f"""WITH c AS ({CLEAN_SIGNALS}) SELECT event_id, id, role, {S.six('product')} AS product,
      {S.six('seniority')} AS seniority, built, flags FROM c""",
)
def coerced(data):
    typed = cl.coerce_signal(F.col("record"))
    return typed_signals(data).select(
        "event_id", typed["id"].alias("id"), typed["role_archetype"].alias("role"),
        six(typed["product_vs_services"]).alias("product"),
        six(typed["seniority_band_fit"]).alias("seniority"),
        typed["built_ranking_or_search"].alias("built"),
        joined(typed["disqualifier_flags"]).alias("flags"),
    )


@query(
    "d6_normalize_word",
    f"""SELECT event_id, CASE event_type {_CASE_ROLE} END AS role FROM events""",
)
def words(data):
    label = F.lit(None).cast("string")
    for name, (raw, _) in _LABELS.items():
        label = F.when(F.col("event_type") == name, raw).otherwise(label)
    return data.table("events").select(
        "event_id", cl.normalize_word(label, ROLES, DEFAULT_ROLE).alias("role")
    )


@query(
    "d7_unit_number",
    f"""SELECT event_id, {S.six(f'''CASE WHEN event_type = 'error' THEN {S.d(.5)}
      ELSE {S.clip('value / 40.0::DOUBLE')} END''')} AS unit FROM events""",
)
def unit_numbers(data):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(
        (F.col("value") / F.lit(40.0)).cast("string")
    )
    return data.table("events").select("event_id", six(cl.unit_number(text)).alias("unit"))


_BOOLS = """CASE event_type WHEN 'view' THEN '{"b": "Yes "}' WHEN 'click' THEN '{"b": 0}'
  WHEN 'signup' THEN '{"b": true}' WHEN 'purchase' THEN '{"b": 2.5}' ELSE '{"b": [1]}' END"""


@query(
    "d8_boolean",
    """SELECT event_id, event_type IN ('view', 'signup', 'purchase') AS flag FROM events""",
)
def booleans(data):
    value = cl.field(F.try_parse_json(F.expr(_BOOLS)), "b")
    return data.table("events").select("event_id", cl.variant_bool(value).alias("flag"))


@query(
    "d9_clean_flags",
    S.using(
        """SELECT id, array_to_string(list_sort(list_distinct(list_filter(flags,
        lambda f: f <> 'other_flag'))), '|') AS flags FROM signals""",
        "signals",
    ),
)
def flags(data):
    shouted = F.transform(
        "disqualifier_flags", lambda f: F.upper(F.replace(f, F.lit("_"), F.lit("-")))
    )
    twice = F.concat(shouted, "disqualifier_flags")
    return data.signals.select("id", joined(cl.clean_flags(twice)).alias("flags"))


@query(
    "d10_clean_text",
    f"""SELECT conv_id, turn, length({S.sq('text')}) AS n, md5({S.sq('text')}) AS digest
    FROM conversations""",
)
def clean_text(data):
    text = squeeze(F.col("text"))
    return data.table("conversations").select(
        "conv_id", "turn", big(F.length(text)).alias("n"), F.md5(text).alias("digest")
    )


_RUBRIC = """CASE event_type WHEN 'view' THEN '{"rubric": {"role_archetypes": ["a"],
  "must_haves": ["b"], "nice_to_haves": ["c"], "hard_disqualifiers": ["d"], "domains": ["e"],
  "seniority_band": {"min_years": 5, "max_years": 9.5}}, "ideal_text": " x  y "}'
  WHEN 'click' THEN '{"rubric": {"role_archetypes": [], "must_haves": "b", "nice_to_haves": ["c"],
  "hard_disqualifiers": ["d"], "domains": [" "], "seniority_band": {"min_years": "5",
  "max_years": 9}}, "ideal_candidate_description": "x"}'
  WHEN 'signup' THEN '{"ideal_text": "x"}' WHEN 'purchase' THEN '[1]' ELSE '{"rubric": {}}' END"""


@query(
    "d11_rubric_checks",
    """SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN
      'rubric.role_archetypes is empty|rubric.must_haves must be a list|' ||
      'rubric.domains is empty|seniority_band.min_years must be a number'
      WHEN 'signup' THEN 'the rubric object is missing' WHEN 'purchase' THEN 'not a JSON object'
      ELSE 'rubric.role_archetypes must be a list|rubric.must_haves must be a list|' ||
      'rubric.nice_to_haves must be a list|rubric.hard_disqualifiers must be a list|' ||
      'rubric.domains must be a list|rubric.seniority_band must be an object|' ||
      'the ideal text is missing' END AS issues FROM events GROUP BY event_type""",
)
def rubrics(data):
    record = F.try_parse_json(F.expr(_RUBRIC))
    issues = joined(rubric_issues(record))
    return (
        data.table("events").select("event_type", issues.alias("issues"))
        .groupBy("event_type", "issues").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "s9_signal_log",
    f"""WITH c AS ({CLEAN_SIGNALS}) SELECT id, arg_max(role, event_id) AS role,
      {S.six('arg_max(product, event_id)')} AS product, arg_max(flags, event_id) AS flags
    FROM c GROUP BY id""",
)
def signal_log(data):
    """The last well-formed line of every user's log, coerced."""
    log = typed_signals(data).withColumn("source_order", F.col("event_id"))
    typed = cl.coerce_signal(F.col("record"))
    latest = latest_records(log, typed, F.col("id") != "")
    return latest.select(
        "id", F.col("role_archetype").alias("role"), six("product_vs_services").alias("product"),
        joined("disqualifier_flags").alias("flags"),
    )


@query(
    "s10_text_log",
    f"""SELECT {S.number('conv_id')} AS id, md5({S.sq('arg_max(text, turn)')}) AS digest,
      CASE WHEN arg_max(role, turn) = 'deterministic' THEN 'deterministic' ELSE 'llm' END
      AS source FROM conversations WHERE {S.sq('text')} <> '' GROUP BY conv_id""",
)
def text_log(data):
    lines = data.table("conversations").select(
        F.col("turn").alias("source_order"),
        F.try_parse_json(
            F.to_json(
                F.struct(
                    record_id(F.col("conv_id")).alias("id"), F.col("text").alias("reasoning"),
                    F.col("role").alias("source"),
                )
            )
        ).alias("record"),
    )
    keep = (F.col("id") != "") & (F.col("text") != "")
    latest = latest_records(lines, cl.coerce_text(F.col("record")), keep, ("id", "text"))
    return latest.select("id", F.md5("text").alias("digest"), "source")


