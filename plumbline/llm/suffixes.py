"""Removal of repeated byte strings by a blockwise sort of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (at a smaller
doc_id, or earlier in the same document). The construction follows difference covers:

* Cover sample. Of each string of LENGTH bytes one suffix is sampled: the one whose first
  ``PREFIX`` bytes have the smallest hash (the leftmost on ties). The choice depends on the
  string alone, so equal strings have a sample at the same shift, which is what a difference
  cover is for. A cover by position would keep one suffix in six or seven; this keeps one in
  39, and needs no comparison at two shifts. A sample stands for the run of strings that
  chose it.
* Suffix buckets. Samples with one prefix are one bucket. Spark deals buckets to tasks and
  sorts one task's buckets by (prefix, rank, place); a task streams through them and holds
  one row, so a bucket of any size takes bounded memory.
* Ranks for long ties. The rank of a sample is the hash of all bytes that its strings cover,
  computed beforehand. Samples that tie there have equal strings throughout, and all but the
  first are settled without a look at their suffixes. Only first samples in buckets of several
  ranks are opened, first into blocks of BLOCK strings, which are bucketed, ranked and settled
  the same way, then the blocks that are still open into their strings (the suffixes cut to
  LENGTH), of which all but the first of equal ones are removed.

Strings are equal where prefix hash, shift and string hash (64 bits each) are. A document is a
doc_id and the hash of a text (``mark``), so texts that share a doc_id are told apart.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes are kept whole; a
row without doc_id is neither earlier nor later than any and is kept whole; different texts that
share a doc_id are documents of their own, in the order of their hashes; repeated rows are cut
alike, and an equal string in a repeat of the same row is not earlier; an empty table gives no
rows; a carried column must not be called like a column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fields, map_batches, map_texts, slices, stored, table

LENGTH, PREFIX, BLOCK = 100, 24, 8
#: Bytes that are hashed at a time; places in them fit in the low bits of a packed minimum.
CHUNK, PLACE_BITS = 1 << 19, 20
SAMPLES = "prefix bigint, rank bigint, doc bigint, mark bigint, place bigint"
SETTLED = "doc bigint, mark bigint, first bigint, last bigint, prefix bigint, opened boolean"
STRINGS = "low bigint, high bigint, doc bigint, mark bigint, place bigint"
RESULT = "doc_id bigint, n_bytes bigint, removed array<struct<first:bigint,past:bigint>>, kept binary"

_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(raw: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Polynomial hashes (mod 2**64) of all strings of the given sizes, by doubling."""
    powers = {1: _BASE}
    level = {1: _TABLE[raw]}
    size = 1
    while 2 * size <= max(sizes):
        half, power = level[size], powers[size]
        level[2 * size] = half[:-size] * power + half[size:]
        size *= 2
        powers[size] = np.uint64(int(power) ** 2 % (1 << 64))
    out = []
    for wanted in sizes:
        found, done = None, 0
        for size in sorted(level, reverse=True):
            if wanted & size:
                part = level[size]
                if found is None:
                    found = part
                else:
                    count = len(raw) - done - size + 1
                    found = found[:count] * powers[size] + part[done : done + count]
                done += size
        out.append(found)
    return out


def scrambled(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cover_samples(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples of the texts raw[starts:ends]: place, first and last string, prefix hash."""
    if len(raw) < LENGTH:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    (prefix,) = window_hashes(raw, PREFIX)
    prefix = scrambled(prefix)
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (prefix & ~low) | np.arange(len(prefix), dtype=np.uint64)
    best = (sliding_minimum(packed, LENGTH - PREFIX + 1) & low).astype(np.int64)
    inside = np.zeros(len(best) + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(valid):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    chosen = best[valid]
    new = np.empty(len(valid), dtype=bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    place = chosen[first]
    return place, valid[first], valid[last], prefix[place].view(np.int64)


def chunked(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Texts joined up to CHUNK bytes; longer ones in overlapping parts.

    Yields ([(text, start in the chunk, end, start in the text)], bytes).
    """
    held, size, joined = [], 0, []
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 1), CHUNK):
            part = text if len(text) <= CHUNK else text[at : at + CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size and size + len(part) > CHUNK:
                yield held, b"".join(joined)
                held, size, joined = [], 0, []
            held.append((number, size, size + len(part), at))
            joined.append(part)
            size += len(part)
    if held:
        yield held, b"".join(joined)


def sample_suffixes(docs: DataFrame) -> DataFrame:
    """SAMPLES of every text; ``place`` packs (place, place - last, place - first)."""

    def make():
        def run(keys, texts):
            out = {name.split()[0]: [] for name in SAMPLES.split(", ")}
            keys = np.array(keys, dtype=np.int64)
            encoded = [text.encode() for text in texts]
            marks = np.array([xxhash.xxh64_intdigest(raw, 42) for raw in encoded],
                             dtype=np.uint64).view(np.int64)
            for held, joined in chunked(encoded):
                number, start, end, offset = map(np.array, zip(*held, strict=True))
                raw = np.frombuffer(joined, dtype=np.uint8)
                place, first, last, prefix = cover_samples(raw, start, end)
                at = np.searchsorted(start, first, side="right") - 1
                digest = xxhash.xxh3_64_intdigest
                view = memoryview(joined)
                rank = np.array(
                    [digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())],
                    dtype=np.uint64,
                )
                early, late = place - first, place - last
                rank ^= (early * 131 + late).astype(np.uint64) * _BASE
                out["prefix"].append(prefix)
                out["rank"].append(rank.view(np.int64))
                out["doc"].append(keys[number[at]])
                out["mark"].append(marks[number[at]])
                own = place - start[at] + offset[at]
                out["place"].append((own << 14) | (late << 7) | early)
            return _settle_here(
                **{
                    name: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
                    for name, parts in out.items()
                }
            )

        return run

    return map_texts(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL"), make, SAMPLES)


def _settle_here(prefix, rank, doc, mark, place) -> dict[str, np.ndarray]:
    """Combines before the shuffle: of samples that tie here, all but the first are settled.

    A settled one has its place inverted (negative) and a bucket by its place, so that a
    common passage sends one row per call to its bucket.
    """
    order = np.lexsort((place, mark, doc, rank, prefix))
    prefix, rank, doc, mark, place = (c[order] for c in (prefix, rank, doc, mark, place))
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] = (prefix[1:] == prefix[:-1]) & (rank[1:] == rank[:-1])
    lead = np.maximum.accumulate(np.where(tied, 0, np.arange(len(order))))
    # Of a repeated row.
    repeated = tied & (doc == doc[lead]) & (mark == mark[lead]) & (place == place[lead])
    spread = (doc.astype(np.uint64) * _BASE + place.astype(np.uint64)) * _BASE
    out = {
        "prefix": np.where(tied, spread.view(np.int64), prefix),
        "rank": np.where(tied, 0, rank), "doc": doc, "mark": mark,
        "place": np.where(tied, ~place, place),
    }
    return {name: column[~repeated] for name, column in out.items()}


def settle_buckets(samples: DataFrame) -> DataFrame:
    """Runs of strings to remove (first and last start), and samples that must be opened.

    An opened sample has its packed place in ``first``.
    """
    ordered = samples.repartition("prefix").sortWithinPartitions(
        "prefix", "rank", "doc", "mark", "place"
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            # Of the bucket at the end of the last batch: its prefix and rank, the first
            # sample of that rank, and the first sample of the bucket while it has one rank.
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(i).to_numpy() for i in range(5)]
                done = columns[4] < 0
                if done.any():
                    own = ~columns[4][done]
                    yield {
                        "doc": columns[2][done], "mark": columns[3][done], "first": (own >> 14) - (own & 127),
                        "last": (own >> 14) - (own >> 7 & 127),
                        "prefix": np.zeros(len(own), np.int64), "opened": np.zeros(len(own), bool),
                    }
                prefix, rank, doc, mark, place = (column[~done] for column in columns)
                if not len(prefix):
                    continue
                same = np.zeros(len(prefix), dtype=bool)
                same[1:] = prefix[1:] == prefix[:-1]
                tied = same.copy()
                tied[1:] &= rank[1:] == rank[:-1]
                goes_on = held is not None and held[0] == prefix[0]
                if goes_on:
                    same[0] = True
                    tied[0] = held[1] == rank[0]
                lead = np.maximum.accumulate(np.where(tied, -1, np.arange(len(prefix))))
                leads = np.stack([doc[lead], mark[lead], place[lead]])
                if goes_on and tied[0]:
                    leads[:, lead < 0] = np.array(held[2])[:, None]
                gone = np.flatnonzero(tied & (np.stack([doc, mark, place]) != leads).any(0))
                # First samples of a rank, the pending one of the last batch before them.
                at = np.flatnonzero(~tied)
                heads = np.stack([prefix[at], doc[at], mark[at], place[at]])
                pending = held[3] if goes_on else None
                if pending is not None:
                    head = np.array([held[0], *pending], dtype=np.int64)[:, None]
                    heads = np.concatenate([head, heads], axis=1)
                names, back, count = np.unique(heads[0], return_inverse=True, return_counts=True)
                several = count[back] > 1
                if goes_on and pending is None:  # its bucket already had several ranks
                    several |= heads[0] == held[0]
                ends = prefix[-1]
                known = several & (heads[0] == ends)
                waiting = heads[1:, heads[0] == ends]
                many = bool(known.any()) or (
                    goes_on and pending is None and held[0] == ends
                )
                held = (
                    ends, rank[-1], leads[:, -1].tolist(),
                    None if many else tuple(waiting[:, 0].tolist()),
                )
                opened = heads[:, several]
                own = place[gone] >> 14
                yield {
                    "doc": np.concatenate([doc[gone], opened[1]]),
                    "mark": np.concatenate([mark[gone], opened[2]]),
                    "first": np.concatenate([own - (place[gone] & 127), opened[3]]),
                    "last": np.concatenate(
                        [own - (place[gone] >> 7 & 127), np.zeros(opened.shape[1], np.int64)]
                    ),
                    "prefix": np.concatenate([np.zeros(len(gone), np.int64), opened[0]]),
                    "opened": np.arange(len(gone) + opened.shape[1]) >= len(gone),
                }

        return run

    return map_batches(ordered, make, SETTLED)


def open_samples(docs: DataFrame, opened: DataFrame, opening, schema: str) -> DataFrame:
    """Rows of ``opening(raw, place, late, early, prefix)`` for the opened samples."""
    wanted = opened.groupBy("doc", "mark").agg(
        F.collect_list(F.struct("first", "prefix")).alias("samples")
    )
    # Repeated rows are opened alike; what they send is told apart by nothing and counts once.
    known = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    texts = known.join(wanted, ["doc", "mark"])
    names = [part.split()[0] for part in schema.split(", ")]

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    parts: dict[str, list] = {name: [] for name in names}
                    columns = (batch.column(n) for n in ("doc", "mark", "text", "samples"))
                    for doc, mark, text, samples in zip(*columns, strict=True):
                        raw = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                        flat = samples.values.flatten()
                        packed, prefix = (part.to_numpy(False) for part in flat)
                        found = opening(
                            raw, packed >> 14, packed >> 7 & 127, packed & 127, prefix
                        )
                        found["doc"] = np.full(len(found["place"]), doc.as_py())
                        found["mark"] = np.full(len(found["place"]), mark.as_py())
                        for name in names:
                            parts[name].append(found[name])
                    yield {
                        name: np.concatenate(part) if part else np.zeros(0, dtype=np.int64)
                        for name, part in parts.items()
                    }

        return run

    return map_batches(texts.select("doc", "mark", "text", "samples"), make, schema)


def as_blocks(raw, place, late, early, prefix) -> dict[str, np.ndarray]:
    """Samples again, one for each block of BLOCK shifts: the bytes that all strings of a
    block share are its bucket, the bytes that its strings cover are its rank."""
    low, high = late // BLOCK, early // BLOCK
    owner, block = _ranges(low, high)
    late, early = np.maximum(late[owner], block * BLOCK), np.minimum(
        early[owner], block * BLOCK + BLOCK - 1
    )
    place = place[owner]
    core = hashes_at(raw, place - block * BLOCK, LENGTH - BLOCK + 1)
    ends = (hashes_at(raw, place - shift, LENGTH) for shift in (early, late))
    rank = next(ends) * _BASE + next(ends) + (early * 131 + late).astype(np.uint64)
    bucket = core + block.astype(np.uint64) * _BASE
    return {
        "prefix": bucket.view(np.int64), "rank": scrambled(rank).view(np.int64),
        "place": (place << 14) | (late << 7) | early,
    }


def as_strings(raw, place, late, early, prefix) -> dict[str, np.ndarray]:
    """STRINGS of samples: (low, high) is the identity of a string."""
    owner, shift = _ranges(late, early)
    start = place[owner] - shift
    return {
        "low": hashes_at(raw, start, LENGTH).view(np.int64),
        "high": (prefix[owner].view(np.uint64) + shift.astype(np.uint64) * _BASE).view(np.int64),
        "place": start,
    }


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, value) for every value of low[i]..high[i]."""
    count = high - low + 1
    owner = np.repeat(np.arange(len(low)), count)
    return owner, low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def hashes_at(raw: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes at each start, a chunk of the text at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    for at in range(0, max(len(raw) - size + 1, 1), CHUNK):
        here = np.flatnonzero((start >= at) & (start < at + CHUNK))
        if len(here):
            (found,) = window_hashes(raw[at : at + CHUNK + size - 1], size)
            out[here] = scrambled(found[start[here] - at])
    return out


def later_strings(strings: DataFrame) -> DataFrame:
    """Starts (doc, first, last) of all strings that also start earlier."""
    ordered = strings.repartition("low", "high").sortWithinPartitions(
        "low", "high", "doc", "mark", "place"
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high, doc, mark, place = (batch.column(i).to_numpy() for i in range(5))
                tied = np.zeros(len(low), dtype=bool)
                tied[1:] = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
                tied[0] = held is not None and (low[0], high[0]) == held[:2]
                lead = np.maximum.accumulate(np.where(tied, -1, np.arange(len(low))))
                leads = np.stack([doc[lead], mark[lead], place[lead]])
                if tied[0]:
                    leads[:, lead < 0] = np.array(held[2])[:, None]
                held = low[-1], high[-1], leads[:, -1].tolist()
                gone = tied & (np.stack([doc, mark, place]) != leads).any(0)
                yield {
                    "doc": doc[gone], "mark": mark[gone], "first": place[gone],
                    "last": place[gone],
                }

        return run

    return map_batches(ordered, make, "doc bigint, mark bigint, first bigint, last bigint")


def cut_text(raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[list, bytes]:
    """Maximal removed runs, and the bytes that are left."""
    n = len(raw)
    edges = np.zeros(n + 1, dtype=np.int32)
    fits = first + LENGTH <= n
    np.add.at(edges, first[fits], 1)
    np.add.at(edges, np.minimum(last[fits] + LENGTH, n), -1)
    gone = np.cumsum(edges[:-1]) > 0
    if not gone.any():
        return [], raw
    change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    spans = change.reshape(-1, 2).tolist()
    return spans, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, removed, kept, carry...) of every document."""
    taken = {part.split()[0] for part in RESULT.split(", ")} | {"text", "_doc", "_mark", "_runs"}
    if taken & set(carry):
        raise ValueError(f"carried columns need other names: {sorted(taken & set(carry))}")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    settled = stored(settle_buckets(sample_suffixes(docs)))
    blocks = open_samples(docs, settled.filter("opened"), as_blocks, SAMPLES)
    finer = stored(settle_buckets(blocks))
    strings = open_samples(docs, finer.filter("opened"), as_strings, STRINGS)
    names = ("doc", "mark", "first", "last")
    settled_runs = settled.unionByName(finer).filter("NOT opened").select(*names)
    runs = settled_runs.unionByName(later_strings(strings))
    grouped = runs.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(
        F.collect_list(F.struct("first", "last")).alias("_runs")
    )
    own = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_mark"))
    joined = docs.join(grouped, own, "left")

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    out = {name: [] for name in ("n_bytes", "removed", "kept")}
                    for text, runs in zip(batch.column("text"), batch.column("_runs")):
                        raw = (text.as_py() or "").encode()
                        spans: list = []
                        if runs.is_valid:
                            first, last = (p.to_numpy(False) for p in runs.values.flatten())
                            spans, left = cut_text(raw, first, last)
                        else:
                            left = raw
                        out["n_bytes"].append(len(raw))
                        out["removed"].append([{"first": a, "past": b} for a, b in spans])
                        out["kept"].append(left)
                    yield out | {n: batch.column(n) for n in ("doc_id", *carry)}

        return run

    columns = joined.select("doc_id", "text", "_runs", *carry)
    return map_batches(columns, make, RESULT + fields(docs, carry))


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate(
        "removed", F.lit(0).cast("bigint"), lambda total, run: total + run.past - run.first
    )
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
