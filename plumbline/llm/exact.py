"""Exact dedup with a heavy-hitter split.

Texts are digested once, where they are read. Misra-Gries counters, one summary a task, find
the digests that may hold at least one row in HEAVY; their rows are then counted exactly, so the
winners that are broadcast are verified. Rows of these groups are decided where they lie and
never shuffled; the rest is shuffled by digest once, in groups of less than one row in HEAVY.

Defined cases: a null text is the empty text; the normaliser (none unless given) is applied
before the digest; texts count as equal by SHA-256. Of equal texts the row with the largest
doc_id stays, a row without doc_id only if no row of its group has one; of repeated rows with
that doc_id exactly one stays. An empty table gives no rows. Other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_batches, stored, table

#: A digest with at least one row in HEAVY is heavy: there are at most HEAVY of them, so the
#: broadcast of their winners has a bound of its own, whatever the data.
HEAVY = 4096

EXACT_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


class Frequent:
    """Misra-Gries: at most ``room`` counters after each batch.

    Of n items, an item's counter is too low by at most n / (room + 1): what is subtracted
    from one counter is subtracted from more than ``room`` of them.
    """

    def __init__(self, room: int):
        self.room, self.counters, self.items = room, Counter(), 0

    def add(self, items: list) -> None:
        self.items += len(items)
        self.counters.update(items)
        if len(self.counters) > self.room:
            cut = sorted(self.counters.values())[-self.room - 1]
            self.counters = Counter({k: n - cut for k, n in self.counters.items() if n > cut})

    def above(self, share: float) -> list[tuple]:
        """The counters that hold at least ``share`` of the items."""
        return [(k, n) for k, n in self.counters.items() if n >= share * self.items]


def digests(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, row, digest) of every document; ``row`` tells apart repeated rows."""
    text = F.coalesce("text", F.lit(""))
    if normalise is not None:
        text = normalise(text)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def heavy_candidates(rows: DataFrame, total: int, heavy: int = HEAVY) -> DataFrame:
    """(digest): at most 2 * heavy digests, among them all that hold total / heavy rows.

    With 4 * heavy counters a task's summary lacks at most a quarter of total / heavy over all
    tasks, and so do the counters a task keeps to itself because they hold less than one of its
    rows in 4 * heavy. What remains of a heavy digest is half of total / heavy or more.
    """

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            found = Frequent(4 * heavy)
            for batch in batches:
                found.add(batch.column("digest").to_pylist())
            kept = found.above(1 / (4 * heavy))
            yield {"digest": [k for k, _ in kept], "n": [n for _, n in kept]}

        return run

    counted = map_batches(rows.select("digest"), make, "digest binary, n bigint")
    return (
        counted.groupBy("digest").agg(F.sum("n").alias("n"))
        .filter(F.col("n") * F.lit(2 * heavy) >= F.lit(total)).select("digest")
    )


def heavy_winners(rows: DataFrame, total: int, heavy: int = HEAVY) -> DataFrame:
    """(digest, size, best): verified groups of total / heavy rows or more, at most ``heavy``.

    ``best`` (doc_id, row) is the row that stays. Only rows of candidates are counted, and they
    are reduced to one row a digest and task before the shuffle.
    """
    candidates = stored(heavy_candidates(rows, total, heavy))
    found = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "row")).alias("best")
    )
    return found.filter((F.col("size") * F.lit(heavy) >= F.lit(total)) & (F.col("size") > 1))


def exact_copies(
    docs: DataFrame, normalise: Callable[[Column], Column] | None = None, heavy: int = HEAVY
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    rows = stored(digests(docs, normalise))
    winners = F.broadcast(stored(heavy_winners(rows, rows.count(), heavy)))
    decided = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select(
        "digest", "doc_id", "row", F.count(F.lit(1)).over(same).alias("size"),
        F.max(F.struct("doc_id", "row")).over(same).alias("best"),
    )
    return decided.select(rest.columns).unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(table(spark, folder, "documents"))
