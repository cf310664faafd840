"""Near-duplicate texts: exact set-similarity on fingerprint words.

Two texts are similar when the Jaccard similarity of their word sets reaches the threshold.
Comparing everything with everything is avoided exactly, not by sampling or capping:

* identical word sets are collapsed first, so a third of the table may be copies;
* sets are compared only when they agree on a *part*: similar sets of up to u words differ in at
  most k = (1-t)/(1+t) * 2u words, so when words are dealt to k + 1 parts, one part holds the
  same words in both (Arasu et al. 2006). A part holds some five words, so what unlike sets
  agree on by chance stays rare however many sets have each single word. Parts are dealt per
  size class, and a set close to the next class takes part in both;
* upper bounds of the words two sets can share then decide without the sets: sizes, and bits
  that every word flips one of, whose differences no shared word can explain.

An index that grows (``textindex``) compares sets by a word of their *prefix* instead: in an
order of all words, rare first, a set of n words and a similar set share one of the first
n - ceil(t*n) + 1 words of each (Chaudhuri et al. 2006, Bayardo et al. 2007). Buckets of single
words grow with the table, and their pairs with its square; the steps below take either.

The question answered is "is there a similar text earlier in the order", so a set needs one
witness only:

1. every bucket (part or prefix word) offers its earliest set: members of a big cluster of near
   copies find it there, in linear work;
2. sets still open are compared with the other members of their buckets, a bucket being cut
   into blocks that meet two by two, and each names its few most alike earlier sets of a block
   pair;
3. sets that are open even then and had further candidates are compared on the words
   themselves, inside the task of the block pair; a witness is all that leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fingerprint_words
from plumbline.operators.durable import durable, stored
from plumbline.operators.skew import map_side_join, salted_join

# Members of one bucket in one block; a task compares two blocks at a time.
BLOCK = 1000
# Least bits of a set, each the parity of the words it stands for.
BITS = 512
# Earlier sets that an open set names in a pair of blocks.
NAMED = 4
# Fixed value: slack against rounding in t * n.
EPSILON = 1e-9
# Ratio of the bounds of a size class, where the threshold allows it.
CLASS = 1.25
PREFIX = "token bigint, set bigint, n int, m int, place int, bins binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def similar(left: Column, right: Column, threshold: float) -> Column:
    """Jaccard of two distinct-word arrays reaches the threshold; empty is never similar."""
    shared = F.size(F.array_intersect(left, right))
    return _reaches(shared, F.size(left), F.size(right), threshold)


def _reaches(shared: Column, a: Column, b: Column, threshold: float) -> Column:
    union = F.greatest(a + b - shared, F.lit(1))
    return (a > 0) & (b > 0) & (
        shared.cast("double") / union.cast("double") >= F.lit(float(threshold))
    )


# --- sets ------------------------------------------------------------------------------


def keyed_words(texts: DataFrame, order: str) -> DataFrame:
    """(id, order, set_key, words), the words sorted; texts without words keep none."""
    worded = texts.select(
        "id", F.col(order).alias("order"),
        F.sort_array(fingerprint_words(F.col("text"))).alias("words"),
    )
    return worded.withColumn("set_key", F.sha2(F.concat_ws(" ", "words"), 256))


def numbered_sets(keyed: DataFrame) -> DataFrame:
    """(set, set_key, first, rows, words): distinct word sets, numbered by their earliest text.

    The numbers grow with ``first`` (order, id) but are not dense: a range partition's number
    in the upper bits, the row in it below. Store the result, so that they stay.
    """
    distinct = keyed.groupBy("set_key").agg(
        F.min(F.struct("order", "id")).alias("first"), F.count(F.lit(1)).alias("rows"),
        # All rows of a key hold the same words.
        F.any_value("words").alias("words"),
    )
    placed = distinct.repartitionByRange("first").sortWithinPartitions("first")
    return placed.select(
        F.monotonically_increasing_id().alias("set"), "set_key", "first", "rows", "words")


def word_order(sets: DataFrame, least: int = 2) -> DataFrame:
    """(word, rows, rank) of the words of at least ``least`` sets: rare first, over all words."""
    counted = (
        sets.select(F.explode("words").alias("word")).groupBy("word")
        .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least)
    )
    placed = counted.repartitionByRange("rows", "word").sortWithinPartitions("rows", "word")
    return placed.select("word", "rows", F.monotonically_increasing_id().alias("rank"))


def ranked_sets(sets: DataFrame, words: DataFrame) -> DataFrame:
    """(set, n, ranks): a set's size and the places of its ordered words, rare first.

    Sets without an ordered word are left out: they share nothing.
    """
    tokens = sets.select("set", F.size("words").alias("n"), F.explode("words").alias("word"))
    # A group is the words of one set.
    return map_side_join(tokens, words, "word").groupBy("set").agg(
        F.any_value("n").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks")
    )


# --- prefixes and bounds ---------------------------------------------------------------


def _bins(values: np.ndarray, rows: np.ndarray, count: int, bits: int = BITS) -> np.ndarray:
    """(count, bits / 64) numbers of each row: every word flips the bit that a hash of it names.

    Bits differ in no more places than sets in words, so what they exclude is excluded rightly.
    ``bits`` is a power of two; the halves of a row combine to the row of half as many bits.
    """
    bit = ((values.astype(np.uint64) * _ODD) >> np.uint64(32)).astype(np.int64) % bits
    flips = np.bincount(rows * bits + bit, minlength=count * bits).astype(np.uint8) & 1
    return np.packbits(flips.reshape(count, bits), axis=1, bitorder="little").view(np.uint64)


def _packed_bins(n: np.ndarray, values: np.ndarray, m: np.ndarray) -> pa.Array:
    """The bits of every row, as many as its set has words or more, but BITS at least."""
    width = BITS << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / BITS)), 0).astype(np.int64)
    packed = np.empty(len(n), dtype=object)
    for bits in np.unique(width).tolist():
        rows = np.flatnonzero(width == bits)
        inside = np.repeat(width == bits, m)
        found = _bins(values[inside], np.repeat(np.arange(len(rows)), m[rows]), len(rows), bits)
        packed[rows] = [row.tobytes() for row in found]
    return pa.array(packed, type=pa.binary())


def prefixes(ranked: DataFrame, threshold: float) -> DataFrame:
    """(token, set, n, m, place, bins) for the prefix words of every set.

    ``m`` is the number of ordered words and ``place`` the word's among them. Words of no other
    set come first in the order, so they use up the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n").to_numpy()
            lists = batch.column("ranks")
            values = lists.flatten().to_numpy()
            m = lists.value_lengths().to_numpy().astype(np.int64)
            least = np.ceil(threshold * size - EPSILON).astype(np.int64)
            keep = np.clip(size - least + 1 - (size - m), 0, m)
            rows = np.repeat(np.arange(len(m)), keep)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(keep) - keep, keep)
            starts = np.cumsum(m) - m
            packed = _packed_bins(size, values, m)
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(values[starts[rows] + place], type=pa.int64()),
                "set": batch.column("set").take(pa.array(rows)),
                "n": pa.array(size[rows], type=pa.int32()),
                "m": pa.array(m[rows], type=pa.int32()),
                "place": pa.array(place, type=pa.int32()),
                "bins": packed.take(pa.array(rows)),
            })

    return ranked.select("set", "n", "ranks").mapInArrow(
        run, PREFIX
    )


# --- parts -----------------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, equal for equal ones."""
    spread = (values ^ (values >> np.uint64(32))) * _MIX
    spread = (spread ^ (spread >> np.uint64(32))) * _MIX
    return spread ^ (spread >> np.uint64(32))


def size_classes(most: int, threshold: float) -> np.ndarray:
    """Lower bounds of the size classes up to one above ``most``.

    A class is wide enough for a set's similar sets to lie in its own or the classes beside it.
    """
    ratio = max(CLASS, 1.0 / threshold)
    bounds = [1]
    while len(bounds) < 3 or bounds[-2] <= most:
        bounds.append(max(bounds[-1] + 1, int(np.ceil(ratio * bounds[-1]))))
    return np.array(bounds, dtype=np.int64)


def _part_keys(
    n: np.ndarray, values: np.ndarray, m: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys of each row): a key for every part of every row, in the order of the rows.

    Equal words of a part give equal keys; by chance unequal ones may, which costs a comparison.
    """
    bounds = size_classes(int(n.max(initial=1)), threshold)
    own = np.searchsorted(bounds, n, side="right") - 1
    # Similar sets of the next class have its least size or more.
    above = n + EPSILON >= threshold * bounds[own + 1]
    differ = (1.0 - threshold) / (1.0 + threshold) * 2 * (bounds[1:] - 1)
    parts = np.floor(differ + EPSILON).astype(np.int64) + 1
    hashed = _mixed(values.astype(np.uint64))
    dealt = (_mixed(hashed + _ODD) >> np.uint64(32)).astype(np.int64)
    low, high = (hashed & np.uint64((1 << 32) - 1)), hashed >> np.uint64(32)
    row_of = np.repeat(np.arange(len(n)), m)
    found, owner = [], []
    for step in (0, 1):
        rows = np.flatnonzero(above) if step else np.arange(len(n))
        family = own[rows] + step
        count = np.zeros(len(n), dtype=np.int64)
        count[rows] = parts[family]
        start = np.cumsum(count) - count
        total = int(count.sum())
        inside = count[row_of] > 0
        of = row_of[inside]
        at = start[of] + dealt[inside] % count[of]
        # Sums of 32 bits are exact in doubles and do not depend on the order.
        sums = [
            np.bincount(at, half[inside].astype(np.float64), total).astype(np.uint64)
            for half in (low, high)
        ]
        holder = np.repeat(rows, parts[family])
        place = (np.arange(total) - start[holder]).astype(np.uint64)
        kind = np.repeat(family, parts[family]).astype(np.uint64)
        named = _mixed((kind << np.uint64(40)) + place)
        found.append(_mixed(_mixed(_mixed(sums[0]) + sums[1]) + named))
        owner.append(holder)
    keys, holder = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(holder, kind="stable")
    return keys[order].view(np.int64), np.bincount(holder, minlength=len(n))


def described(ranked: DataFrame, threshold: float) -> DataFrame:
    """(set, n, m, place, bins, tokens): a set's sizes, counted words and keys of its parts.

    A part has no place in the order of words, so ``place`` is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            lists = batch.column("ranks")
            values = lists.flatten().to_numpy()
            m = lists.value_lengths().to_numpy().astype(np.int64)
            keys, held = _part_keys(n, values, m, threshold)
            ends = pa.array(np.append(0, np.cumsum(held)), type=pa.int32())
            yield pa.RecordBatch.from_pydict({
                "set": batch.column("set"),
                "n": pa.array(n, type=pa.int32()),
                "m": pa.array(m, type=pa.int32()),
                "place": pa.array(np.zeros(len(m)), type=pa.int32()),
                "bins": _packed_bins(n, values, m),
                "tokens": pa.ListArray.from_arrays(ends, pa.array(keys)),
            })

    return ranked.select("set", "n", "ranks").mapInArrow(
        run, "set bigint, n int, m int, place int, bins binary, tokens array<bigint>"
    )


def met_keys(keys: DataFrame) -> DataFrame:
    """The rows (token, set) whose token others may have.

    Range partitioned by (token, set), so a hot token spans as many partitions as it needs. The
    first and the last token of a partition may go on beside it and are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else join_batches([held, batch])
            token = whole.column("token").to_numpy()
            first = token[0] if first is None else first
            same = token[1:] == token[:-1]
            kept = token == first
            kept[1:] |= same
            kept[:-1] |= same
            # The last row waits for what follows it, along with one row of its token.
            held = whole.slice(len(token) - 2 if len(same) and same[-1] else len(token) - 1)
            if held.num_rows == 2:
                yield whole.filter(pa.array(kept)).slice(0, int(kept.sum()) - 2)
            else:
                kept[-1] = False
                yield whole.filter(pa.array(kept))
        if held is not None:
            yield held

    ordered = keys.repartitionByRange("token", "set").sortWithinPartitions("token", "set")
    return ordered.mapInArrow(run, "token bigint, set bigint")


# --- members ---------------------------------------------------------------------------


class Members:
    """Members of a bucket, by column: size, ordered words, place of the word, bins."""

    def __init__(self, batch: pa.RecordBatch):
        self.n, self.m, self.place = (
            batch.column(name).to_numpy().astype(np.int64) for name in ("n", "m", "place")
        )
        packed = batch.column("bins")
        self.width = np.array(pc.binary_length(packed)).astype(np.int64) // 8
        self.start = np.cumsum(self.width) - self.width
        self.bins = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint64)
        self._folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row, bins): rows of ``width`` numbers and more, folded to ``width``."""
        if width not in self._folds:
            rows = np.flatnonzero(self.width >= width)
            bins = np.empty((len(rows), width), dtype=np.uint64)
            for wide in np.unique(self.width[rows]).tolist():
                some = self.width[rows] == wide
                whole = self.bins[self.start[rows[some]][:, None] + np.arange(wide)]
                bins[some] = np.bitwise_xor.reduce(
                    whole.reshape(-1, wide // width, width), axis=1)
            place = np.zeros(len(self.width), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self._folds[width] = place, bins
        return self._folds[width]

    def apart(self, i: np.ndarray, other: Members, j: np.ndarray) -> np.ndarray:
        """Bits in which rows ``i`` and rows ``j`` of ``other`` differ, pair by pair."""
        differ = np.zeros(len(i), dtype=np.int64)
        least = np.minimum(self.width[i], other.width[j])
        for width in np.unique(least).tolist():
            pairs = np.flatnonzero(least == width)
            (mine, bins), (its, other_bins) = self.folded(width), other.folded(width)
            for at in range(0, len(pairs), 1 << 14):
                part = pairs[at : at + (1 << 14)]
                flipped = bins[mine[i[part]]] ^ other_bins[its[j[part]]]
                differ[part] = np.bitwise_count(flipped).sum(axis=1, dtype=np.int64)
        return differ


def can_match(a: Members, i: np.ndarray, b: Members, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows ``i`` of a and ``j`` of b, pair by pair, can be similar."""
    n, other = a.n[i], b.n[j]
    needed = threshold / (1.0 + threshold) * (n + other) - EPSILON
    most = np.minimum(a.place[i], b.place[j]) + np.minimum(
        a.m[i] - a.place[i], b.m[j] - b.place[j]
    )
    found = (np.minimum(n, other) + EPSILON >= threshold * np.maximum(n, other)) & (most >= needed)
    where = np.flatnonzero(found)
    i, j = i[where], j[where]
    found[where] = (a.m[i] + b.m[j] - a.apart(i, b, j)) // 2 >= needed[where]
    return found


# --- witnesses -------------------------------------------------------------------------


def with_leads(placed: DataFrame, threshold: float) -> DataFrame:
    """Prefix rows sorted into buckets, with ``lead``: the bucket's first set if it can match.

    Buckets are range partitioned by (token, set), so a hot word spans as many partitions as it
    needs, each with a lead of its own. Rows stream; a task holds a batch and one lead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else join_batches([held, batch])
            token = whole.column("token").to_numpy()
            starts = np.ones(len(token), dtype=bool)
            starts[1:] = token[1:] != token[:-1]
            lead = np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))
            rows = np.flatnonzero(~starts)
            facts = Members(whole)
            near = np.zeros(len(token), dtype=bool)
            near[rows] = can_match(facts, rows, facts, lead[rows], threshold)
            named = whole.column("set").take(pa.array(lead))
            found = pa.RecordBatch.from_arrays(
                [*whole.columns, pa.array(named.to_numpy(), mask=~near)],
                [*whole.schema.names, "lead"],
            )
            yield found if held is None else found.slice(1)
            held = whole.slice(int(lead[-1]), 1)

    ordered = placed.repartitionByRange("token", "set").sortWithinPartitions("token", "set")
    return ordered.mapInArrow(run, f"{PREFIX}, lead bigint")


def verified(pairs: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """The pairs (set, other) that really are similar. ``pairs`` is read several times."""
    # Sets in no pair do not travel, if the ids of the others are few enough for every task.
    part = pairs.select("set").unionByName(pairs.select(F.col("other").alias("set"))).distinct()
    ranked = ranked.join(part, "set", "left_semi")
    right = ranked.select(
        F.col("set").alias("other"), F.col("n").alias("other_n"),
        F.col("ranks").alias("other_ranks"),
    )
    # One set may be the partner of any share of the pairs (the lead of a big cluster).
    partnered = salted_join(pairs, right, "other", "set")
    both = partnered.join(ranked, "set")
    shared = F.size(F.array_intersect("ranks", "other_ranks"))
    return both.filter(_reaches(shared, F.col("n"), F.col("other_n"), threshold)).select(
        "set", "other")


GROUP = ("token", "i", "j")


def block_pairs(
    members: DataFrame, open_sets: DataFrame, block: int, facts: DataFrame | None = None
) -> DataFrame:
    """Members of buckets with open sets, dealt to pairs of blocks and sorted by pair.

    The members of a bucket of b blocks go to b groups each, and b * (b + 1) / 2 groups see
    every two members once; a group holds two blocks. What members have beside (token, set)
    comes from ``facts``, if they have it in every bucket.
    """
    if facts is not None:
        members = members.select("token", "set")
    told = [name for name in members.columns if name not in ("token", "set")]
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    wanted = members.select("set", "token").join(open_sets, "set").select("token").distinct()
    blocks = F.ceil(F.col("rows") / F.lit(block)).cast("int")
    dealt = map_side_join(members, stored(sizes.join(wanted, "token")), "token").select(
        "token", "set", *told,
        F.pmod(F.xxhash64("set"), blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    )
    marked = dealt.join(open_sets.withColumn("open", F.lit(True)), "set", "left")
    marked = (marked if facts is None else marked.join(facts, "set")).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", F.coalesce("open", F.lit(False)).alias("open"), "set", "n", "m", "place", "bins",
    )
    return marked.repartition(*GROUP).sortWithinPartitions(*GROUP, "set")


def join_batches(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a GROUP ends; holds one batch and one group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _keys(batch)
        if held and (keys[0] != last).any():
            yield join_batches(held)
            held = []
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        if len(edges):
            cut = int(edges[-1]) + 1
            yield join_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
        last = keys[-1]
    if held:
        yield join_batches(held)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(name).to_numpy() for name in GROUP], axis=1)


# Pairs looked at together.
PAIRS = 1 << 18


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of an open set, row of an earlier set of its group, first row of the group).

    A pair of blocks sees pairs across the blocks, or all pairs of one block; all pairs of a
    row come together.
    """
    keys = _keys(batch)
    own = batch.column("own").to_numpy()
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = (keys[1:] != keys[:-1]).any(1)
    start = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
    across = keys[:, 1] != keys[:, 2]
    rows = np.flatnonzero(batch.column("open").to_numpy(False) & ~begins)
    counts = np.arange(len(keys))[rows] - start[rows]
    ends = np.cumsum(counts)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
        part, number = rows[at:stop], counts[at:stop]
        later = np.repeat(part, number)
        within = np.arange(len(later)) - np.repeat(np.cumsum(number) - number, number)
        earlier = np.repeat(start[part], number) + within
        fits = ~across[later] | (own[later] != own[earlier])
        yield later[fits], earlier[fits], start[later[fits]]
        at = stop


def _alike_pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """(set, other, more): every open set's NAMED most alike earlier sets of each block pair.

    ``more`` says that the block pair has further candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            facts, number = Members(batch), batch.column("set").to_numpy()
            for later, earlier, _ in _pairs(batch):
                near = can_match(facts, later, facts, earlier, threshold)
                later, earlier = later[near], earlier[near]
                order = np.lexsort((earlier, facts.apart(later, facts, earlier), later))
                later, earlier = later[order], earlier[order]
                starts = np.flatnonzero(np.append(True, later[1:] != later[:-1])[: len(later)])
                held = np.diff(np.append(starts, len(later)))
                named = np.arange(len(later)) - np.repeat(starts, held) < NAMED
                more = np.repeat(held > NAMED, held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[later[named]]), pa.array(number[earlier[named]]),
                     pa.array(more[named])],
                    ["set", "other", "more"],
                )

    found = dealt.mapInArrow(run, "set bigint, other bigint, more boolean")
    return found.groupBy("set", "other").agg(F.bool_or("more").alias("more"))


def _involved(dealt: DataFrame, threshold: float) -> DataFrame:
    """(GROUP..., own, open, set) of the sets of a block pair that are part of a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            facts, part = Members(batch), np.zeros(batch.num_rows, dtype=bool)
            for later, earlier, _ in _pairs(batch):
                near = can_match(facts, later, facts, earlier, threshold)
                part[later[near]] = True
                part[earlier[near]] = True
            yield batch.filter(pa.array(part)).select([*GROUP, "own", "open", "set"])

    return dealt.mapInArrow(
        run, "token bigint, i int, j int, own int, open boolean, set bigint"
    )


def _found_in_blocks(dealt: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """(set): open sets with a similar earlier set, compared word by word in their block pairs."""
    worded = stored(_involved(dealt, threshold)).join(ranked, "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            number, n = (batch.column(c).to_numpy() for c in ("set", "n"))
            words = [frozenset(value) for value in batch.column("ranks").to_pylist()]
            found = set()
            for later, earlier, _ in _pairs(batch):
                low, high = np.minimum(n[later], n[earlier]), np.maximum(n[later], n[earlier])
                sizes = low + EPSILON >= threshold * high
                for a, b in zip(later[sizes].tolist(), earlier[sizes].tolist(), strict=True):
                    if a not in found:
                        shared = len(words[a] & words[b])
                        if shared / (n[a] + n[b] - shared) >= threshold:
                            found.add(a)
            yield pa.RecordBatch.from_arrays([pa.array(number[sorted(found)])], ["set"])

    ordered = worded.repartition(*GROUP).sortWithinPartitions(*GROUP, "set")
    return ordered.select(*GROUP, "own", "open", "set", "n", "ranks").mapInArrow(
        run, "set bigint").distinct()


def later_sets(
    ranked: DataFrame, threshold: float, block: int = BLOCK, exact: DataFrame | None = None
) -> DataFrame:
    """(set) of the sets that have a similar set before them.

    ``exact`` has the words by which pairs are confirmed, if ``ranks`` are hashes.
    """
    facts = stored(described(ranked, threshold))
    keys = stored(met_keys(facts.select(F.explode("tokens").alias("token"), "set")))
    facts = facts.drop("tokens")
    members = keys.join(facts, "set").select("token", "set", "n", "m", "place", "bins")
    members = stored(with_leads(members, threshold).select("token", "set", "lead"))
    ranked = ranked if exact is None else exact
    led_by = members.filter("lead IS NOT NULL").select("set", F.col("lead").alias("other"))
    pairs = stored(led_by.distinct())
    led = stored(verified(pairs, ranked, threshold).select("set").distinct())
    members = members.drop("lead")
    seekers = stored(members.select("set").distinct().join(led, "set", "left_anti"))
    pairs = stored(_alike_pairs(block_pairs(members, seekers, block, facts), threshold))
    alike = stored(
        verified(pairs.select("set", "other"), ranked, threshold).select("set").distinct()
    )
    several = pairs.filter("more").select("set").distinct()
    left = stored(several.join(alike, "set", "left_anti"))
    found = led.unionByName(alike)
    if left.isEmpty():
        return found
    return found.unionByName(
        _found_in_blocks(block_pairs(members, left, block, facts), ranked, threshold)
    )


def near_duplicates(
    texts: DataFrame, order: str, threshold: float = 0.85, block: int = BLOCK
) -> DataFrame:
    """(id, is_duplicate): does a similar text come earlier in (``order``, id).

    A text without words is never a duplicate.
    """
    keyed = stored(keyed_words(texts, order)).filter(F.size("words") > 0)
    sets = stored(numbered_sets(keyed))
    worded = sets.select("set", F.size("words").alias("n"), F.col("words").alias("ranks"))
    hashed = worded.withColumn("ranks", F.transform("ranks", lambda word: F.xxhash64(word)))
    late = later_sets(hashed, threshold, block, worded).withColumn("late", F.lit(True))
    marked = sets.select("set", "set_key", "first", "rows").join(late, "set", "left")
    # One set may be the key of any share of the texts (copies of one text).
    own = map_side_join(keyed.select("id", "order", "set_key"), stored(marked), "set_key")
    found = own.select(
        "id",
        ((F.struct("order", "id") > F.col("first")) | F.coalesce("late", F.lit(False))).alias(
            "_found"),
    )
    return texts.select("id").join(found, "id", "left").select(
        "id", F.coalesce("_found", F.lit(False)).alias("is_duplicate")
    )


def similar_pairs(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, other) with id < other for every similar pair of a *cut* of texts.

    The result itself is all similar pairs, so this is for report-sized inputs (the
    texts of a top-n), whose joins need no care for hot words; whole tables are answered by
    :func:`near_duplicates`, texts against a collection by ``textindex``.
    """
    worded = durable(
        texts.select("id", fingerprint_words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
    )
    tokens = worded.select("id", F.explode("words").alias("word"))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    # A group is the words of one text.
    ordered = tokens.join(counts, "word").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("rows", "word"))).alias("w")
    )
    size = F.size("w")
    keep = size - F.ceil(F.lit(threshold) * size - F.lit(EPSILON)).cast("int") + F.lit(1)
    placed = durable(ordered.select("id", F.explode(F.slice(F.col("w.word"), 1, keep)).alias("t")))
    pairs = placed.join(placed.withColumnRenamed("id", "other"), "t").filter(
        F.col("id") < F.col("other")).select("id", "other").distinct()
    right = worded.select(F.col("id").alias("other"), F.col("words").alias("other_words"))
    both = pairs.join(worded, "id").join(right, "other")
    return both.filter(similar(F.col("words"), F.col("other_words"), threshold)).select(
        "id", "other")
