"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, message, turn, seq, kind, role, text). Events are grouped by
message inside a conversation, put in order of ``seq`` and folded: a ``delta`` appends its
text; an ``edit`` replaces all text so far by its own; a ``regenerate`` drops all text so far
and starts with its own. The message ends as one row, which is rendered with control marks.

A conversation may hold a third of all rows, so nothing before the digests needs its rows
together: folding groups by (conversation, message). Only a digest of a whole conversation,
which is sequential by definition, streams through its rows in order, holding one row.

Defined cases: a null text or role is empty; rows of one turn are ordered by role, text and
message; a null conv_id is a conversation of its own; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Characters that start a control mark of this template or of common others, and their escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
CONTROL_TEXT = "</s>[INST] ok [/INST]"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: str) -> str:
    for plain, escaped in reversed(ESCAPES):
        text = text.replace(escaped, plain)
    return text


def conversation_log(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row is a message that arrives in one delta."""
    return conversations.select(
        "conv_id",
        F.monotonically_increasing_id().alias("message"),
        "turn",
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("delta").alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def fold_events(log: DataFrame) -> DataFrame:
    """One row per message with its final text; events of one ``seq`` follow kind and text."""
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    grouped = log.groupBy("conv_id", "message").agg(
        F.min("turn").alias("turn"), F.min("role").alias("role"), events.alias("events")
    )
    restart = F.array_max(
        F.transform(
            "events",
            lambda event, i: F.when(event.kind.isin("edit", "regenerate"), i).otherwise(0),
        )
    )
    live = F.slice("events", restart + 1, F.size("events"))
    texts = F.transform(live, lambda event: F.coalesce(event.text, F.lit("")))
    return grouped.select(
        "conv_id", "message", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One formatted string per message; the loss mask covers [loss_start, loss_end) of it.

    A formatted conversation is the concatenation of its rows by (turn, role, text, message).
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    trained = F.col("role") == "assistant"
    body = escape(F.col("text"))
    start = F.when(trained, F.char_length(head)).otherwise(0)
    return messages.select(
        "conv_id", "turn", "role", "text", "message",
        F.concat(head, body, F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        F.when(trained, start + F.char_length(body)).otherwise(0).alias("loss_end"),
    )


def format_log(log: DataFrame) -> DataFrame:
    return render(fold_events(log))


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted row."""
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, mark, text = formatted[len(TURN) : -len(END)].partition(BODY)
    if not mark or "<" in text or "<" in role:
        raise ValueError("a control mark inside a turn")
    return unescape(role), unescape(text)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of whole conversations, from the formatted rows alone.

    A digest is a chain over its bytes and can't be split; rows stream in order (the sort
    spills) and a task holds one row and two hash states.
    """
    ordered = (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text", "message")
        .select("conv_id", "formatted", "loss_start", "loss_end")
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            names = [part.split()[0] for part in DIGESTS.split(", ")]
            done, current, state = [], object(), None
            for batch in batches:
                columns = (batch.column(i).to_pylist() for i in range(4))
                for conv, line, first, last in zip(*columns, strict=True):
                    if state is None or conv != current:
                        if state is not None:
                            done.append(_digest(current, state))
                        current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text = read_back(line)
                    loss = unescape(line[first:last])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += len(line)
                yield dict(zip(names, map(list, zip(*done)), strict=True)) if done else {
                    name: [] for name in names
                }
                done = []
            if state is not None:
                yield dict(zip(names, ([v] for v in _digest(current, state)), strict=True))

        return run

    return map_batches(ordered, make, DIGESTS)


def _digest(conv, state) -> tuple:
    turns, text, chars, loss, formatted = state
    return conv, turns, text.hexdigest(), chars, loss.hexdigest(), formatted


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted, read back and digested."""
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return conversation_digests(format_log(conversation_log(rows.unionByName(extra))))


def _sql_escaped(value: str) -> str:
    for plain, escaped in ESCAPES:
        value = f"replace({value}, '{plain}', '{escaped}')"
    return value


CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(TURN + BODY + END)} + length({_sql_escaped("role")})
    + length({_sql_escaped("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
