"""Best-fit packing of token sequences, improved by best-two-fit.

Pieces of one length are interchangeable, so the plan needs only the number of pieces per
length: at most ``CAPACITY`` numbers, whatever the size of the corpus. A plan is a list of
patterns with multiplicities. A pattern is filled greedily (the longest remaining piece, then
the longest that fits the gap, and so on); then its smallest piece gives way to the two
unpacked pieces that fill the expanded gap the most, if they leave a smaller gap.

The pieces themselves never meet: each has a number among those of its length, from its place
in its task and the counts of the tasks before, and looks its sequence up in the plan.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.attribution import VOCABULARY, encoder
from plumbline.llm.chunks import ChunkMemory
from plumbline.llm.common import map_batches, map_texts, stored, table

CAPACITY, CLOSING_ID = 2048, 0
# Chunks that a task remembers: about 60 MB, beside an executor's heap.
CHUNKS = 200_000
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"
)
PACKED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with the task that made them and their place in it."""

    def make():
        loaded = encoder(path)
        memory = ChunkMemory(
            lambda chunk: array("I", loaded.encode_ordinary(chunk)).tobytes(), CHUNKS)
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)

        def run(keys, texts):
            rows = []
            for key, text in zip(keys, texts, strict=True):
                ids = memory.code(text) + closing
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((key, piece, start, length, crc, task, int(seen[length])))
                    seen[length] += 1
            names = [part.split()[0] for part in PIECES.split(", ")]
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return run

    return map_texts(docs, make, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order) with the number of sequences of each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    sizes = np.arange(capacity + 1)
    patterns = []
    while left.any():
        chosen: list[int] = []
        gap = capacity
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            chosen.append(int(fitting[-1]))
            left[chosen[-1]] -= 1
            gap -= chosen[-1]
        if gap and len(chosen) > 1:
            room = gap + chosen[-1]
            # longest[x]: the longest remaining length up to x, 0 if none.
            longest = np.maximum.accumulate(np.where(left > 0, sizes, 0))
            one = np.flatnonzero(left[: room + 1])
            limit = np.minimum(one, room - one)
            limit -= (limit == one) & (left[one] < 2)
            two = longest[np.maximum(limit, 0)]
            total = np.where(two > 0, one + two, 0)
            if len(one) and total.max() > chosen[-1]:
                best = int(total.argmax())
                left[chosen.pop()] += 1
                chosen += [int(one[best]), int(two[best])]
                left[one[best]] -= 1
                left[two[best]] -= 1
        used = np.bincount(chosen, minlength=capacity + 1)
        times = 1 + int((left[used > 0] // used[used > 0]).min())
        left -= used * (times - 1)
        patterns.append((chosen, times))
    return patterns


def places(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict:
    """Per length: from which number on (ascending), first sequence there, and offset."""
    out = {length: ([], [], []) for length in range(1, capacity + 1)}
    given = dict.fromkeys(out, 0)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            number, first, at = out[length]
            number.append(given[length])
            first.append(sequence)
            at.append(offset)
            given[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in out.items() if v[0]}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = stored(token_pieces(docs, path, capacity))
    counts = stored(
        pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("rows"))
    )
    histogram = counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()
    lookup = places(plan({row.length: row.rows for row in histogram}, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    before = F.sum("rows").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # Sorted together: offsets grow with the tasks, so they aren't broadcast; a piece is short.
    numbered = pieces.join(offsets.hint("merge"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("place")).alias("number"),
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                lengths = batch.column("length").to_numpy()
                numbers = batch.column("number").to_numpy()
                sequence, offset = np.empty_like(numbers), np.empty_like(numbers)
                for length in np.unique(lengths):
                    rows = np.flatnonzero(lengths == length)
                    start, first, at = shared.value[int(length)]
                    run_at = np.searchsorted(start, numbers[rows], side="right") - 1
                    sequence[rows] = first[run_at] + numbers[rows] - start[run_at]
                    offset[rows] = at[run_at]
                yield {
                    name: batch.column(name)
                    for name in ("doc_id", "piece", "start", "length", "ids_crc32")
                } | {"sequence_id": sequence, "offset": offset}

        return run

    return map_batches(numbered, make, PACKED)


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
