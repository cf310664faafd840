"""Grounded texts (G*) and their reports (A12, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.catalog.scoring import GAPS, TOP_TEXT
from plumbline.catalog.texts import fingerprint_sql
from plumbline.config import GAP_CUES, GENERIC_WORDS
from plumbline.functions import grounding as gr
from plumbline.functions import text as tx
from plumbline.functions.scalar import fixed_any
from plumbline.operators import explain
from plumbline.operators.durable import durable
from plumbline.operators.enrich import from_records
from plumbline.operators.neardup import similar
from plumbline.operators.summary import gap_honesty, text_counts
from plumbline.plans.jobs import ranked_top, scored_pool, write_explanations

TOP = 100
_WORD = "'[A-Za-z][A-Za-z0-9]*'"
_NUM = r"'[0-9]+(?:\.[0-9]+)?'"

_CORPUS = """array_to_string(list_filter(list_concat([title, lang, summary, source, lang],
  flatten(list_transform(career, lambda r: [r.company, r.title, r.description])),
  [{evidence}]), lambda p: p IS NOT NULL AND p <> ''), ' ')"""
_NUMBERS = f"""list_distinct(list_concat(
  list_transform(regexp_extract_all(corpus, {_NUM}), lambda x: x::DOUBLE),
  [years, floor(years), round_even(years, 0), ceil(years)],
  CASE WHEN notice IS NULL THEN []::DOUBLE[] ELSE [notice::DOUBLE] END,
  list_transform(career, lambda r: r.months::DOUBLE),
  list_transform(career, lambda r: round_even(r.months::DOUBLE / 12.0::DOUBLE, 0))))"""
_CLOSED = {
    "corp": f"SELECT *, {_CORPUS.format(evidence='NULL')} AS corpus FROM pool",
    "closed": f"SELECT *, list_distinct(regexp_extract_all(lower(corpus), {_WORD})) AS terms, "
              f"{_NUMBERS} AS nums FROM corp",
}


def _closed(data):
    """Every record with the words and numbers its own text allows."""
    corpus = gr.closed_world(
        F.col("profile"), F.col("career_history"), F.lit(None).cast("string")
    )
    rows = data.pool.withColumn("corpus", corpus)
    return rows.select(
        "id", "corpus",
        gr.known_terms(F.col("corpus")).alias("terms"),
        gr.known_numbers(
            F.col("corpus"), F.col("profile.years_of_experience"),
            F.col("activity.notice_period_days"), F.col("career_history"),
        ).alias("numbers"),
    )


@query(
    "g1_facts",
    S.using(
        f"""SELECT id, rank, trim(title) AS title, coalesce(s_role, '') AS role,
        coalesce(s_domain, '') AS domain, coalesce(s_evidence, '') AS evidence,
        coalesce(s_built, false) AS built, {S.six('coalesce(s_product, 0.5::DOUBLE)')} AS product,
        {S.six('final')} AS final, notice::BIGINT AS notice, is_open, relocates, last_active
        FROM ranked WHERE rank <= {TOP}""",
        "ranked",
    ),
)
def facts(data):
    rows = explain.facts(ranked_top(data, TOP), data.texts_pool, data.settings.text)
    return rows.select(
        "id", "rank", "title", "role", "domain", "evidence", "built",
        six("product_ratio").alias("product"), six("final").alias("final"),
        big("notice_days").alias("notice"), "is_open", "relocates", "last_active",
    )


@query(
    "g2_closed_world",
    S.using("SELECT id, length(corpus) AS n, md5(corpus) AS digest, len(terms) AS terms "
            "FROM closed", "pool", **_CLOSED),
)
def closed_world(data):
    return _closed(data).select(
        "id", big(F.length("corpus")).alias("n"), F.md5("corpus").alias("digest"),
        big(F.size("terms")).alias("terms"),
    )


@query(
    "g3_known_numbers",
    S.using(
        f"""SELECT id, array_to_string(list_transform(list_sort(nums),
        lambda x: {S.six('x')}), '|') AS numbers FROM closed""",
        "pool", **_CLOSED,
    ),
)
def known_numbers(data):
    shown = F.transform(F.sort_array("numbers"), lambda x: fixed_any(x))
    return _closed(data).select("id", joined(shown).alias("numbers"))


@query(
    "g4_gap_notes",
    S.using(f"SELECT id, array_to_string({GAPS}, '; ') AS gaps FROM scored", "scored"),
)
def gap_notes(data):
    rows = scored_pool(data)
    gaps = gr.gap_notes(
        F.col("flags"), F.col("notice_days"), F.col("availability"), F.col("is_open"),
        data.settings.text,
    )
    return rows.select("id", joined(gaps, "; ").alias("gaps"))


def _named(text: str) -> str:
    return f"""list_distinct(flatten(list_transform(regexp_split_to_array({text}, '[.!?]+'),
      lambda s: list_filter(regexp_extract_all(s, {_WORD}), lambda w, i: length(w) >= 2 AND
        (regexp_full_match(w, '[A-Z][A-Z0-9]*') OR regexp_matches(w, '^.+[A-Z]') OR
        (i > 1 AND regexp_full_match(w, '[A-Z][a-z0-9]*[a-z][a-z0-9]*')))))))"""


@query(
    "g5_named_terms",
    f"""SELECT doc_id, array_to_string(list_sort({_named('text')}), '|') AS named
      FROM documents""",
)
def named_terms(data):
    named = F.sort_array(gr.named_terms(F.col("text")))
    return data.table("documents").select("doc_id", joined(named).alias("named"))


_GENERIC = S.quoted(GENERIC_WORDS)
_STRIPPED = "regexp_replace(regexp_replace(t.text, '^\\s+', ''), '\\s+$', '')"
_BAD_TERMS = f"""list_sort(list_filter({_named('body')}, lambda w: lower(w) NOT IN ({_GENERIC})
  AND NOT list_contains(terms, lower(w))))"""
_BAD_NUMBERS = f"""list_sort(list_distinct(list_filter(regexp_extract_all(body, {_NUM}),
  lambda n: len(list_filter(nums, lambda a: abs(n::DOUBLE - a) < 0.5::DOUBLE)) = 0)))"""
_CHECKED = {
    **_CLOSED,
    "paired": f"SELECT t.id, t.source AS made_by, {_STRIPPED} AS body, terms, nums FROM texts t "
              "JOIN closed c ON c.id = t.id",
    "bad": f"SELECT *, {_BAD_TERMS} AS bad_terms, {_BAD_NUMBERS} AS bad_nums, "
           f"len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda p: {S.sq('p')} <> '')) "
           "AS n_sentences FROM paired",
    "issued": """SELECT *, CASE WHEN body = '' THEN ['empty reasoning'] ELSE list_filter([
      CASE WHEN length(body) < 30 THEN 'too short (' || length(body) || ' chars)' END,
      CASE WHEN length(body) > 360 THEN 'too long (' || length(body) || ' chars)' END,
      CASE WHEN n_sentences > 3 THEN 'too many sentences (>3)' END,
      CASE WHEN len(bad_terms) > 0 THEN 'ungrounded terms: ' || array_to_string(bad_terms, ', ')
      END,
      CASE WHEN len(bad_nums) > 0 THEN 'ungrounded numbers: ' || array_to_string(bad_nums, ', ')
      END], lambda x: x IS NOT NULL) END AS issues FROM bad""",
}


def _checked(data):
    return explain.check_texts(data.texts, _closed(data), data.settings.text)


@query(
    "g6_ungrounded",
    S.using(
        """SELECT id, array_to_string(bad_terms, '|') AS terms,
        array_to_string(bad_nums, '|') AS numbers FROM bad""",
        "pool", "texts", **_CHECKED,
    ),
)
def ungrounded(data):
    rows = data.texts.join(_closed(data), "id")
    return rows.select(
        "id", joined(gr.ungrounded_terms(F.col("text"), F.col("terms"))).alias("terms"),
        joined(
            gr.ungrounded_numbers(F.col("text"), F.col("numbers"), data.settings.text)
        ).alias("numbers"),
    )


@query(
    "g7_verdict",
    S.using(
        """SELECT id, len(issues) = 0 AS ok, array_to_string(issues, '; ') AS issues
        FROM issued""",
        "pool", "texts", **_CHECKED,
    ),
)
def verdict(data):
    return _checked(data).select(
        "id", (F.size("issues") == 0).alias("ok"), joined("issues", "; ").alias("issues")
    )


@query(
    "g8_fallback_text",
    S.using(f"SELECT id, fallback FROM written WHERE rank <= {TOP}", "ranked", written=TOP_TEXT),
)
def fallback(data):
    rows = explain.with_fallback(ranked_top(data, TOP), data.settings.text)
    return rows.select("id", "fallback")


_WSET = f"""CASE WHEN {fingerprint_sql('text')} = '' THEN []::VARCHAR[] ELSE
  list_distinct(string_split({fingerprint_sql('text')}, ' ')) END"""


@query(
    "g9_similar_turns",
    f"""WITH w AS (SELECT conv_id, turn, {_WSET} AS s FROM conversations),
      p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s)) AS x, len(a.s) AS na,
        len(b.s) AS nb FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, na > 0 AND nb > 0 AND x::DOUBLE / greatest(na + nb - x, 1)::DOUBLE
      >= 0.2::DOUBLE AS similar FROM p""",
)
def similar_turns(data):
    """Neighbouring turns whose word sets overlap by a fifth."""
    turns = data.table("conversations").select(
        "conv_id", "turn", tx.fingerprint_words(F.col("text")).alias("words")
    )
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words")
    )
    both = turns.join(following, ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn", similar(F.col("words"), F.col("next_words"), 0.2).alias("similar")
    )


_QUALITY = {
    **_CHECKED,
    "quality": f"""SELECT r.id, t.text, t.source AS made_by, {GAPS} AS gaps,
      {S.contains_any('lower(t.text)', GAP_CUES)} AS cue FROM ranked r
      LEFT JOIN texts t ON t.id = r.id WHERE rank <= {TOP}""",
}


def _quality(data):
    rows = explain.facts(ranked_top(data, TOP), data.texts_pool, data.settings.text)
    return explain.quality_rows(rows, data.texts, data.settings.text)


@query(
    "g11_gap_honesty",
    S.using(
        """SELECT sum((len(gaps) > 0)::BIGINT)::BIGINT AS with_gap,
        sum((len(gaps) > 0 AND coalesce(cue, false))::BIGINT)::BIGINT AS disclosed
        FROM quality""",
        "ranked", "texts", quality=_QUALITY["quality"],
    ),
)
def honesty(data):
    return gap_honesty(_quality(data))


@query(
    "a14_gap_rows",
    S.using(
        """SELECT id, array_to_string(gaps, '; ') AS gaps, coalesce(cue, false) AS disclosed
        FROM quality WHERE len(gaps) > 0""",
        "ranked", "texts", quality=_QUALITY["quality"],
    ),
)
def gap_rows(data):
    rows = _quality(data).filter(F.size("gaps") > 0)
    return rows.select("id", joined("gaps", "; ").alias("gaps"),
                       F.col("mentions_gap").alias("disclosed"))


_TOP_CHECKED = {
    # The evidence of a ranked record belongs to its closed world.
    "top_pool": f"""SELECT pool.*, coalesce(r.s_evidence, '') AS ev FROM pool
      JOIN ranked r ON r.id = pool.id WHERE r.rank <= {TOP}""",
    **_CHECKED,
    "corp": f"SELECT *, {_CORPUS.format(evidence='ev')} AS corpus FROM top_pool",
}


@query(
    "a12_text_counts",
    S.using(
        """SELECT count(*) AS n, sum((text IS NOT NULL AND made_by = 'llm')::BIGINT)::BIGINT
        AS generated, sum(coalesce(made_by = 'deterministic', false)::BIGINT)::BIGINT AS computed,
        sum((text IS NULL)::BIGINT)::BIGINT AS missing,
        (SELECT count(*) FROM issued WHERE len(issues) > 0) AS failed FROM quality""",
        "pool", "ranked", "texts", **_TOP_CHECKED, quality=_QUALITY["quality"],
    ),
)
def counts(data):
    """Where the texts of the best hundred come from, and how many fail their checks."""
    return text_counts(_quality(data)).select("n", "generated", "computed", "missing", "failed")


@query("g10_accepted_texts")
def accepted(data):
    """Texts of the best hundred that have none, from recorded answers that repeat the title.

    Records with one title get one text, which exercises retry and fallback.
    """
    top = ranked_top(data, TOP)
    said = F.concat(F.lit("works as "), F.lower(gr.clean_title(F.col("title"))),
                    F.lit(" and fits the search role well."))
    record = F.to_json(F.struct("id", said.alias("reasoning")))
    ask = from_records(durable(top.select("id", record.alias("record"))))
    rows = write_explanations(
        top, data.texts_pool, data.texts, data.settings, {"domains": ["ranking"]}, ask
    )
    return rows.select("id", "rank", "text", "source", "attempt")
