"""Text operators (T*). Long texts leave a query as length and MD5."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import sql as S
from plumbline.catalog.base import big, joined, query, six
from plumbline.config import GAP_CUES
from plumbline.functions import text as tx
from plumbline.functions.scalar import fixed_any, squeeze
from plumbline.plans.dataset import KEYWORDS
from plumbline.plans.jobs import encoder_texts, profile_cards

CUES = (*GAP_CUES, "license", "ouon", "eaux")


def _digest(value):
    return [big(F.length(value)).alias("n"), F.md5(value).alias("digest")]


def _digest_sql(value: str) -> str:
    return f"length({value}) AS n, md5({value}) AS digest"


@query("t1_squeeze", f"SELECT doc_id, {_digest_sql(S.sq('text'))} FROM documents")
def squeezed(data):
    return data.table("documents").select("doc_id", *_digest(squeeze(F.col("text"))))


@query("t2_career_text", S.using(f"SELECT id, {_digest_sql('career_text')} FROM pool", "pool"))
def career_texts(data):
    text = tx.career_text(F.col("profile"), F.col("career_history"), None)
    return data.pool.select("id", *_digest(text))


SIGNAL_LINE = """concat_ws(', ', 'last_active=' || last_active,
  'open_to_work=' || CASE WHEN is_open THEN 'True' WHEN NOT is_open THEN 'False' END,
  'recruiter_response_rate=' || r_resp_text, 'interview_completion_rate=' || r_int_text,
  'notice_period_days=' || notice::VARCHAR,
  'willing_to_relocate=' || CASE WHEN relocates THEN 'True' WHEN NOT relocates THEN 'False' END)"""
# Rates come from small counts, so both engines print their shortest form alike.
RATES = "SELECT *, r_resp::VARCHAR AS r_resp_text, r_int::VARCHAR AS r_int_text FROM pool"


def _role_line(r: str) -> str:
    return f"""'- ' || {S.sq(f'{r}.title')} || ' @ ' || {S.sq(f'{r}.company')} || ' (' ||
      {r}.months::VARCHAR || ' mo)' || CASE WHEN {S.sq(f'{r}.description')} <> ''
      THEN ': ' || {S.sq(f'{r}.description')} ELSE '' END"""


CARD = f"""concat_ws(chr(10),
  'Current role: ' || {S.sq('title')} || ' · ' || format('{{:g}}', years) || ' yrs experience · '
    || {S.sq('lang')},
  'Summary: ' || {S.sq('summary')},
  CASE WHEN len(career) > 0 THEN 'Career history:' || chr(10) || array_to_string(
    list_transform(career[1:6], lambda r: {_role_line('r')}), chr(10)) END,
  CASE WHEN line <> '' THEN 'Availability signals: ' || line END)"""


@query(
    "t3_profile_card",
    S.using(
        f"SELECT id, {_digest_sql('card')} FROM cards", "pool", rates=RATES,
        lined=f"SELECT *, {SIGNAL_LINE} AS line FROM rates",
        cards=f"SELECT id, {CARD} AS card FROM lined",
    ),
)
def cards(data):
    return profile_cards(data).select("id", *_digest(F.col("text")))


@query(
    "t4_role_lines",
    S.using(
        f"""SELECT id, len(career) AS roles, md5(array_to_string(list_transform(career,
        lambda r: {_role_line('r')}), chr(10))) AS digest FROM pool""",
        "pool",
    ),
)
def role_lines(data):
    career = F.col("career_history")
    lines = F.array_join(F.transform(career, tx.role_line), "\n")
    return data.pool.select("id", big(F.size(career)).alias("roles"), F.md5(lines).alias("digest"))


@query(
    "t5_signal_line",
    S.using(f"SELECT id, {SIGNAL_LINE} AS line FROM rates", "pool", rates=RATES),
)
def signal_lines(data):
    return data.pool.select("id", tx.signal_line(F.col("activity")).alias("line"))


@query(
    "t6_query_prefix",
    S.using(
        f"""SELECT id, {_digest_sql("'Represent this sentence for searching relevant passages: '"
                                    " || career_text")} FROM pool""",
        "pool",
    ),
)
def query_prefix(data):
    text = tx.prefixed(data.settings.vector.query_prefix, F.col("text"))
    return encoder_texts(data).select("id", *_digest(text))


@query(
    "t7_keyword_evidence",
    S.using(f"SELECT id, {S.six(S.LEXICAL)} AS evidence FROM rec", "rec"),
)
def keyword_evidence(data):
    text = tx.career_text(F.col("profile"), F.col("career_history"), None)
    return data.pool.select("id", six(tx.keyword_evidence(text, KEYWORDS)).alias("evidence"))


def _clip_sql(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({S.sq(text)}) <= {limit} THEN {S.sq(text)} ELSE "
        f"rtrim(substring({S.sq(text)}, 1, {limit - 1})) || '…' END"
    )


@query("t8_clip_text", f"SELECT doc_id, {_clip_sql('text', 120)} AS clipped FROM documents")
def clipped(data):
    return data.table("documents").select(
        "doc_id", tx.clip_text(F.col("text"), 120).alias("clipped")
    )


@query(
    "t9_truncate_words",
    f"""SELECT doc_id, CASE WHEN length({S.sq('text')}) <= 240 THEN {S.sq('text')} ELSE
    regexp_replace(substring({S.sq('text')}, 1, 240), ' [^ ]*$', '') || '…' END AS cut
    FROM documents""",
)
def truncated(data):
    return data.table("documents").select(
        "doc_id", tx.truncate_words(F.col("text"), 240).alias("cut")
    )


EXCERPT = f"""array_to_string(list_transform(career[1:3], lambda r: trim(r.title) || ' @ ' ||
  trim(r.company) || ' (' || r.months::VARCHAR || 'mo)' || CASE WHEN {S.sq('r.description')} <> ''
  THEN ': ' || {_clip_sql('r.description', 120)} ELSE '' END), ' | ')"""


@query("t10_career_excerpt", S.using(f"SELECT id, {EXCERPT} AS excerpt FROM pool", "pool"))
def excerpts(data):
    return data.pool.select("id", tx.career_excerpt(F.col("career_history")).alias("excerpt"))


_WORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')"


@query(
    "t11_words",
    f"""SELECT doc_id, len({_WORDS}) AS words, md5(array_to_string({_WORDS}, ' ')) AS digest
    FROM documents""",
)
def word_tokens(data):
    found = tx.words(F.col("text"))
    return data.table("documents").select(
        "doc_id", big(F.size(found)).alias("words"), F.md5(joined(found, " ")).alias("digest")
    )


@query(
    "t12_numbers",
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text,
    '[0-9]+(?:\.[0-9]+)?'), lambda x: format('{:.6f}', x::DOUBLE)), '|') AS numbers
    FROM documents""",
)
def number_tokens(data):
    found = F.transform(tx.numbers(F.col("text")), lambda x: fixed_any(x))
    return data.table("documents").select("doc_id", joined(found).alias("numbers"))


SENTENCES = f"len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: {S.sq('p')} <> ''))"


@query("t13_sentence_count", f"SELECT doc_id, {SENTENCES} AS sentences FROM documents")
def sentence_counts(data):
    return data.table("documents").select(
        "doc_id", big(tx.sentence_count(F.col("text"))).alias("sentences")
    )


def fingerprint_sql(text: str) -> str:
    inner = rf"regexp_replace(lower({text}), '[0-9]+(?:\.[0-9]+)?', '#', 'g')"
    return f"trim(regexp_replace({inner}, '[^a-z#]+', ' ', 'g'))"


@query(
    "t14_fingerprint",
    f"SELECT doc_id, {_digest_sql(fingerprint_sql('text'))} FROM documents",
)
def fingerprints(data):
    return data.table("documents").select("doc_id", *_digest(tx.fingerprint(F.col("text"))))


@query(
    "t15_readable_join",
    S.using(
        """SELECT id, CASE WHEN len(flags) = 0 THEN '' WHEN len(flags) = 1 THEN flags[1]
        ELSE array_to_string(flags[1:len(flags) - 1], ', ') || ' and ' || flags[len(flags)] END
        AS listed FROM signals""",
        "signals",
    ),
)
def readable(data):
    return data.signals.select("id", tx.readable_join(F.col("disqualifier_flags")).alias("listed"))


@query(
    "t16_cues",
    f"SELECT doc_id, {S.contains_any('lower(text)', CUES)} AS has_cue FROM documents",
)
def cues(data):
    return data.table("documents").select(
        "doc_id", tx.mentions_gap(F.col("text"), CUES).alias("has_cue")
    )
