"""Importance resampling towards a target by hashed n-grams.

A text's UTF-8 bytes go through a table of 256 bytes that lower-cases A-Z and blanks
separators; ``bytes.split`` gives the words. The CRC-32 of an n-gram is that of the n-gram one
word shorter, continued over a space and the next word. Counters reduce the features of a batch,
of a task, then, in Spark, of all tasks. The counts of BUCKETS buckets, a table whose size is a
parameter, are all that reaches the driver; its gains go back with the scoring tasks.

Documents are drawn by score (weight plus Gumbel noise from the id). The number drawn follows
the number of documents, so no cut is collected: a count of rows per score finds the score at
which the drawing ends, and only rows from there on are put in order.

Defined cases: a null or empty text has no features, weight 0 and is too short to be drawn; a
row without doc_id has a weight, but neither score nor rank, and is not among the documents
drawn from; repeated rows are drawn one by one and ranked in any order among themselves; long
texts are read in pieces that end at a separator; an empty table gives no rows, an empty target
counts as one without features. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, map_texts, slices, stored, table
from plumbline.operators.ordering import positions

#: Contract: buckets, longest run of words, least words of a drawn document, per cent drawn.
BUCKETS, NGRAM, LEAST_WORDS, PER_CENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of one text that are split at a time.
PIECE = 1 << 22

WORD_BYTES = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)}
TRANSLATE = bytes(
    low if low in WORD_BYTES else ord(" ") for low in bytes(range(256)).lower()
)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The translated text in pieces of about ``size`` bytes that end at a separator."""
    clean = raw.translate(TRANSLATE)
    at = 0
    while at < len(clean):
        stop = clean.find(b" ", at + size)
        stop = len(clean) if stop < 0 else stop
        yield clean[at:stop]
        at = stop


def grams(text: str, longest: int = NGRAM, size: int = PIECE) -> Iterator[list[int]]:
    """CRC-32 values of all runs of 1 to ``longest`` words; first the words, then by length."""
    tail: list[bytes] = []
    for piece in pieces(text.encode(), size):
        words = piece.split()
        hashed = list(map(zlib.crc32, words))
        yield hashed
        if longest > 1:
            # Runs that begin in the words kept from the piece before end in this one.
            joined = tail + words
            spaced = [b" " + word for word in joined]
            hashed = list(map(zlib.crc32, joined))
            for length in range(2, longest + 1):
                hashed = list(map(zlib.crc32, spaced[length - 1 :], hashed))
                yield hashed[max(len(tail) - length + 1, 0) :]
            tail = joined[-longest + 1 :]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = NGRAM) -> np.ndarray:
    """Features of all texts per bucket; a task sends a row per bucket it has met."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            total: Counter = Counter()
            for batch in batches:
                hashed: Counter = Counter()
                for part in slices(batch, "text"):
                    for text in part.column("text").to_pylist():
                        for found in grams(text or "", longest):
                            hashed.update(found)
                for value, n in hashed.items():
                    total[value % buckets] += n
            yield {"bucket": list(total), "n": list(total.values())}

        return run

    counted = map_batches(docs.select("text"), make, "bucket int, n bigint")
    # At most ``buckets`` rows.
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * log ratio) of every bucket's smoothed shares, in doubles."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return [
        math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all)))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]


def noise(doc_id: int, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(
    docs: DataFrame, gained: list[int], longest: int = NGRAM, seed: str = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def make() -> Callable:
        gain = dict(zip(count(), gained, strict=False))
        buckets = len(gained)

        def one(text: str) -> tuple[int, int, int]:
            words = features = total = 0
            for place, found in enumerate(grams(text, longest)):
                features += len(found)
                words += len(found) if place % longest == 0 else 0
                total += sum(n * gain[value % buckets] for value, n in Counter(found).items())
            return words, features, total // features if features else 0

        def run(keys: list, texts: list[str]) -> dict:
            found = [one(text) for text in texts]
            return {
                "doc_id": keys,
                "n_words": [words for words, _, _ in found],
                "n_features": [features for _, features, _ in found],
                "weight": [weight for _, _, weight in found],
                "score": [
                    None if key is None else weight + noise(key, seed)
                    for key, (_, _, weight) in zip(keys, found, strict=True)
                ],
            }

        return run

    return map_texts(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make,
        "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint",
    )


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank); rank is null for rows that are not drawn.

    ``scored`` is read three times, so it should be stored.
    """
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    per_score = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Scores are thousandths of a log ratio: their number does not follow the rows.
    histogram = sorted(per_score.collect(), reverse=True)
    wanted = per_cent * sum(n for _, n in histogram) // 100
    lowest, reached = None, 0
    for lowest, n in histogram:
        reached += n
        if reached >= wanted:
            break
    near = F.coalesce(able & (F.col("score") >= F.lit(lowest)), F.lit(False)) if wanted else F.lit(False)
    columns = ("doc_id", "n_features", "weight", "score")
    placed = positions(scored.filter(near).select(*columns), [F.desc("score"), F.asc("doc_id")])
    drawn = placed.select(
        *columns, F.when(F.col("rank") <= F.lit(wanted), F.col("rank")).alias("rank")
    )
    rest = scored.filter(~near).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = NGRAM,
    least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: str = SEED,
) -> DataFrame:
    """Weights, scores and places in the draw of all ``docs`` towards the texts of ``target``."""
    gained = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return draw(stored(weights(docs, gained, longest, seed)), least_words, per_cent)


def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: CRC-32 by its bit rule (polynomial 0xEDB88320), as a fold over the bytes of a word.
_FEATURES = """
SELECT {key} AS k, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {name}"""
RESAMPLING_SQL = f"""
WITH docs AS ({_FEATURES.format(key="doc_id", name="documents")}),
goal AS ({_FEATURES.format(key="0", name="benchmark")}),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(
  range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
  FROM range(256) AS bytes(i))),
words AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM docs UNION ALL
  SELECT word FROM goal)),
coded AS (SELECT word, xor(4294967295, list_reduce(
  list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
  lambda c, b: xor(c // 256, crcs[1 + xor(c % 256, b)]), 4294967295)) % 10000 AS bucket
  FROM words, crc_table),
pairs AS (SELECT k, bucket, count(*) AS n FROM docs JOIN coded USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM pairs GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN coded USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE
  * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE
  * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)),
summed AS (SELECT k, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total
  FROM pairs JOIN gain USING (bucket) GROUP BY k),
weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features,
  coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN summed ON doc_id = k),
scored AS (SELECT doc_id, n_features, weight,
  weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
  count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
