"""Near-duplicates by circulant MinHash, banding and exact verification.

A document's set is its distinct shingles of SHINGLE words. Two permutations give all
coordinates of a signature: one scatters the shingles over 32 bits, the other is applied to
the scattered value shifted by 0, 1, 2, ...; a coordinate is the minimum over the set. Bands
of ROWS coordinates put documents into buckets. With 40 bands of 4, a pair at the similarity
of 0.75 meets in no bucket with probability 3e-7.

Documents with one set are one node, so copies cost nothing further. Buckets are searched in two
steps; every candidate is confirmed on the full sets, and nodes linked so far count as one
component:

1. every member of a bucket against the bucket's first member;
2. in buckets that still hold several components, all pairs of different components whose
   signatures agree in at least LEAST_ALIKE of the coordinates (a pair at 0.75 falls below with
   probability 4e-14). Buckets are cut into blocks; the task of two blocks compares the full
   sets, joins what is similar in a union-find and gives out a spanning forest only: fewer links
   than members, and no pair that is not a link.

Pairs inside a component need no look: they change no component. Components are found by
contracting the links, in Spark; then nodes and labels that hold many rows are joined map-side.

Defined cases: a null text or one without words has an empty set, is linked with nothing and
is kept; with fewer words the whole sequence is the one shingle; rows that share a doc_id are
separate documents; a row without doc_id takes part and is kept if no row of its component
has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, map_texts, stored, table
from plumbline.operators.skew import map_side_join

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
WIDTH = BANDS * ROWS
#: Coordinates in a signature; the first WIDTH make the bands, a byte of each is compared.
COORDINATES = 512
MARK = "text_hash"
#: Far enough below 0.75 that the bands, not this, decide what is missed.
LEAST_ALIKE = 0.6
BLOCK = 1000
#: Links of one node that a task confirms at a time.
SLICE = 64
#: Bytes whose words are hashed at a time.
CHUNK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64)]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTERS[[32, *range(9, 14)]] = 0


def word_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit polynomial hash of every word; long texts in parts that end at a word."""
    starts, codes, at = [], [], 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + CHUNK)
        stop = gap.start() if gap else len(raw)
        part = np.frombuffer(raw, dtype=np.uint8, count=stop - at, offset=at)
        value = _LETTERS[part]  # 0 for white space
        word = value != 0
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        start = np.flatnonzero(opens)
        if len(start):
            place = np.arange(len(part))
            place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(part))))
            place *= word
            codes.append(np.add.reduceat(value * _powers(int(place.max()) + 1)[place], start))
            starts.append(start + at)
        at = stop
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(codes)


def _powers(count: int) -> np.ndarray:
    """At least ``count`` powers of the odd base mod 2**64."""
    if len(_POWERS[0]) < count:
        _POWERS[0] = np.cumprod(np.full(2 * count, _ODD)) * _INVERSE
    return _POWERS[0]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles."""
    # bytes.lower() knows A-Z only; a line break keeps the words of two texts apart.
    raw = [text.encode().lower() for text in texts]
    begins = np.cumsum([0, *(len(text) + 1 for text in raw)])
    starts, codes = word_codes(b"\n".join(raw))
    words = np.searchsorted(starts, begins)
    found = _mixed(codes, SHINGLE)
    out = []
    for first, past in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if past - first >= SHINGLE:
            out.append(np.unique(found[first : past - SHINGLE + 1]))
        else:
            out.append(_mixed(codes[first:past], past - first))
    return out


def _mixed(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes."""
    if not size or len(codes) < size:
        return np.zeros(0, dtype=np.uint64)
    found = np.full(len(codes) - size + 1, size, dtype=np.uint64)
    for shift in range(size):
        found = (found ^ codes[shift : len(codes) - size + 1 + shift]) * _ODD
        found ^= found >> np.uint64(31)
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) coordinates; the sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    start = 0
    past = np.cumsum(sizes)
    while start < len(sets):  # as many sets as fit in the cache
        before = past[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(past, before + (1 << 16))))
        joined = np.concatenate(sets[start:stop])
        places = np.cumsum(sizes[start:stop]) - sizes[start:stop]
        scattered = ((joined * _ODD) >> np.uint64(32)).astype(np.uint32)
        turned, half = np.empty_like(scattered), np.empty_like(scattered)
        for shift in range(COORDINATES):
            np.add(scattered, np.uint32(shift), out=turned)
            for odd in (0x85EBCA6B, 0xC2B2AE35):
                np.right_shift(turned, np.uint32(16), out=half)
                np.bitwise_xor(turned, half, out=turned)
                np.multiply(turned, np.uint32(odd), out=turned)
            out[start:stop, shift] = np.minimum.reduceat(turned, places)
        start = stop
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(coordinates), BANDS), dtype=np.uint64)
    grouped = coordinates[:, :WIDTH].reshape(-1, BANDS, ROWS).astype(np.uint64)
    for row in range(ROWS):
        keys = (keys ^ grouped[:, :, row]) * _ODD
        keys ^= keys >> np.uint64(29)
    return ((keys ^ np.arange(BANDS, dtype=np.uint64)) * _ODD).view(np.int64)


def set_node(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def describe(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, n_shingles, bands, bytes, carry...) of every document; no node for empty sets."""
    schema = "doc_id bigint, node bigint, n_shingles bigint, bands array<bigint>, bytes binary"

    def make():
        def run(keys, texts):
            sets = shingle_sets(texts)
            full = [i for i, values in enumerate(sets) if len(values)]
            out = {name: [None] * len(sets) for name in ("node", "bands", "bytes")}
            if full:
                found = signatures([sets[i] for i in full])
                bands, low = band_keys(found), found.astype(np.uint8)
                for place, i in enumerate(full):
                    out["node"][i] = set_node(sets[i])
                    out["bands"][i] = bands[place]
                    out["bytes"][i] = low[place].tobytes()
            return {"doc_id": keys, "n_shingles": [len(s) for s in sets]} | out

        return run

    return map_texts(docs, make, schema, carry=carry)


def first_links(members: DataFrame) -> DataFrame:
    """(a, b): members of a bucket with its first one; rows stream, a task holds one."""
    ordered = members.select("band", "node").repartition("band").sortWithinPartitions(
        "band", "node"
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                band, node = (batch.column(i).to_numpy() for i in range(2))
                same = np.zeros(len(band), dtype=bool)
                same[1:] = band[1:] == band[:-1]
                same[0] = held is not None and held[0] == band[0]
                lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(band))))
                first = node[lead]
                if same[0]:
                    first[lead < 0] = held[1]
                held = band[-1], first[-1]
                pairs = np.unique(np.stack([first[same], node[same]]), axis=1)
                yield {"a": pairs[0], "b": pairs[1]}

        return run

    return map_batches(ordered, make, "a bigint, b bigint").distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component."""
    named = with_label(members, "node", labels, "part")
    several = (
        named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .filter("low <> high").select("band")
    )
    return named.join(several, "band")


PAIR = ("band", "i", "j")
_DEALT = "band bigint, i int, j int, slot int, own int, node bigint, part bigint"


def block_pairs(opened: DataFrame) -> DataFrame:
    """Members dealt to pairs of blocks (PAIR..., slot, own, node, part).

    A bucket of n blocks is n * (n + 1) / 2 groups of two blocks; a member goes to n of them.
    """
    counts = opened.groupBy("band").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    dealt = opened.join(counts, "band").withColumn("own", block).select(
        "band", "slot", "node", "part", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    return dealt.select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "slot", "own", "node", "part",
    )


class Pair:
    """The members of a pair of blocks and which of them are alike."""

    def __init__(self, group: dict):
        self.node, self.size, self.own = (group[n] for n in ("node", "n_shingles", "own"))
        self.i, self.j, self.slot = (int(group[n][0]) for n in ("i", "j", "slot"))
        self.signs = np.frombuffer(b"".join(group["bytes"]), dtype=np.uint8)
        self.signs = self.signs.reshape(-1, COORDINATES)
        self.bands = np.stack(group["bands"])
        self.part = np.unique(group["part"], return_inverse=True)[1]

    def others(self, k: int) -> np.ndarray:
        """Members of the other block, of one block those behind, alike and not yet joined.

        A pair is looked at in the first bucket that it shares, which whole band keys decide.
        """
        apart = self.part != self.part[k]
        if self.i != self.j:
            apart &= self.own != self.i
        else:
            apart[: k + 1] = False
        low, high = np.minimum(self.size, self.size[k]), np.maximum(self.size, self.size[k])
        fits = np.flatnonzero(apart & (100 * low >= PERCENT * high))
        agree = (self.signs[fits] == self.signs[k]).sum(1)
        fits = fits[agree >= LEAST_ALIKE * COORDINATES]
        return fits[(self.bands[fits] == self.bands[k]).argmax(1) == self.slot]

    def rows(self) -> np.ndarray:
        """Members to compare with others: one block, or all of it."""
        return np.flatnonzero(self.own == self.i)


def involved(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """The dealt members that are alike to one of another component in their pair of blocks."""
    facts = dealt.join(nodes.select("node", "n_shingles", "bytes", "bands"), "node")
    ordered = facts.repartition(*PAIR).sortWithinPartitions(*PAIR, "node")
    names = [*PAIR, "slot", "own", "node", "part"]

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for group in _groups(batches, PAIR):
                pair = Pair(group)
                chosen = np.zeros(len(pair.node), dtype=bool)
                for k in pair.rows():
                    found = pair.others(k)
                    chosen[found] = True
                    chosen[k] |= len(found) > 0
                if chosen.any():
                    yield {name: group[name][chosen] for name in names}

        return run

    return map_batches(ordered.select(*names, "n_shingles", "bytes", "bands"), make, _DEALT)


def forest(chosen: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join the components of each pair of blocks, fewer than its members."""
    facts = chosen.join(nodes.select("node", "n_shingles", "bytes", "bands"), "node")
    ordered = facts.join(sets, "node").repartition(*PAIR).sortWithinPartitions(*PAIR, "node")

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for group in _groups(batches, PAIR):
                pair = Pair(group)
                full = [np.frombuffer(blob, dtype=np.uint64) for blob in group["shingles"]]
                links = []
                for k in pair.rows():
                    for other in pair.others(k):
                        if pair.part[other] != pair.part[k] and similar_sets(full[k], full[other]):
                            links.append((pair.node[k], pair.node[other]))
                            pair.part[pair.part == pair.part[other]] = pair.part[k]
                yield {"a": [a for a, _ in links], "b": [b for _, b in links]}

        return run

    names = [*PAIR, "slot", "own", "node", "part", "n_shingles", "bytes", "bands", "shingles"]
    return map_batches(ordered.select(*names), make, "a bigint, b bigint").distinct()


def similar_sets(left: np.ndarray, right: np.ndarray) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= PERCENT * (len(left) + len(right) - common)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict]:
    """Runs of rows with equal keys, as arrays by column; holds one run and one batch."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy(False) for n in batch.schema.names}
        change = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            change[1:] |= columns[key][1:] != columns[key][:-1]
        if held and all(held[-1][key][-1] == columns[key][0] for key in keys):
            pass
        elif held:
            yield {n: np.concatenate([part[n] for part in held]) for n in columns}
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for first, past in zip(edges, edges[1:], strict=False):
            if first:
                yield {n: np.concatenate([part[n] for part in held]) for n in columns}
                held = []
            held.append({n: column[first:past] for n, column in columns.items()})
    if held:
        yield {n: np.concatenate([part[n] for part in held]) for n in held[0]}


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """(node, holder, rows, smallest, n_shingles, bands, bytes): a set once; ``holder`` (doc_id,
    mark) names a row that has it, with a doc_id if one has."""
    row = F.struct("doc_id", MARK)
    holder = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row))
    return rows.filter("node IS NOT NULL").groupBy("node").agg(
        holder.alias("holder"), F.count(F.lit(1)).alias("rows"),
        F.min("doc_id").alias("smallest"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("bytes").alias("bytes"),
    )


def marked(docs: DataFrame) -> DataFrame:
    """Adds MARK, a hash that tells apart the texts of rows that share a doc_id."""
    return docs.withColumn(MARK, F.xxhash64("text"))


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the holders, from marked documents; a row has one node at most, but for
    texts with one hash."""
    holders = nodes.select(
        "node", F.col("holder.doc_id").alias("_holder"), F.col(f"holder.{MARK}").alias("_hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_holder")) & (F.col(MARK) == F.col("_hash"))
    return docs.join(holders, same).select("node", "text")


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the given (node, holder), from the texts again."""
    texts = node_texts(docs, nodes)

    def sets():
        def run(keys, values):
            found = shingle_sets(values)
            # Of texts that share a doc_id and a hash, the one that is the node's.
            own = [i for i, s in enumerate(found) if len(s) and set_node(s) == keys[i]]
            return {"node": [keys[i] for i in own],
                    "shingles": [found[i].tobytes() for i in own]}

        return run

    found = map_texts(texts, sets, "node bigint, shingles binary", key="node")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The sets of the ``b`` side meet their ``a`` in slices of at most about SLICE links.
    """
    size = nodes.select("node", "n_shingles", "bytes")
    a, b = (size.select(*[F.col(c).alias(f"{x}_{c}") for c in size.columns]) for x in "ab")
    facts = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    facts = facts.filter(
        F.lit(100) * F.least("a_n_shingles", "b_n_shingles")
        >= F.lit(PERCENT) * F.greatest("a_n_shingles", "b_n_shingles")
    )

    def likely():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                left, right = (
                    np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint8)
                    .reshape(-1, COORDINATES) for n in ("a_bytes", "b_bytes")
                )
                near = (left == right).sum(1) >= LEAST_ALIKE * COORDINATES
                yield {n: batch.column(n).to_numpy()[near] for n in ("a", "b")}

        return run

    wanted = stored(map_batches(facts, likely, "a bigint, b bigint"))
    counts = wanted.groupBy("a").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).cast("int").alias("slices")
    )
    dealt = wanted.join(counts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice")
    )
    right = dealt.join(sets, F.col("b") == F.col("node")).select(
        "a", "slice", F.col("b").alias("other"), "shingles"
    )
    left = (
        counts.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        .join(sets, F.col("a") == F.col("node"))
        .select("a", "slice", F.lit(None).cast("bigint").alias("other"), "shingles")
    )
    ordered = (
        left.unionByName(right).repartition("a", "slice")
        .sortWithinPartitions("a", "slice", F.col("other").asc_nulls_first())
    )

    def similar():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held = None
            for batch in batches:
                out = {"a": [], "b": []}
                columns = (batch.column(n) for n in ("a", "other"))
                for one, other, blob in zip(
                    *(c.to_pylist() for c in columns), batch.column("shingles"), strict=True
                ):
                    values = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                    if other is None:
                        held = values.copy()
                        continue
                    if similar_sets(held, values):
                        out["a"].append(one)
                        out["b"].append(other)
                yield out

        return run

    return map_batches(ordered.select("a", "other", "shingles"), similar, "a bigint, b bigint")


def with_label(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """Adds the label of ``column``, itself where it has none."""
    renamed = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    joined = rows.join(renamed, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(name, F.coalesce("_label", column)).drop("_node", "_label")


def contract(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of all linked nodes, the label being the smallest node of a component.

    In a round every node moves to its smallest neighbour, then three times to where that
    one moved; links between what is left go on. A chain shrinks eightfold in a round.
    """
    if labels is not None:
        links = with_label(with_label(links, "a", labels, "x"), "b", labels, "y").select(
            F.col("x").alias("a"), F.col("y").alias("b")
        )
    while True:
        edges = stored(
            links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b").distinct()
        )
        if edges.isEmpty():
            break
        moves = stored(edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed(
            "a", "node"))
        for _ in range(3):
            moves = with_label(moves, "label", moves, "next").select(
                "node", F.col("next").alias("label")
            )
        moves = stored(moves)
        if labels is None:
            labels = moves
        else:
            old = with_label(labels, "label", moves, "next").select(
                "node", F.col("next").alias("label")
            )
            fresh = moves.join(labels.select("node"), "node", "left_anti")
            labels = stored(old.unionByName(fresh))
        links = with_label(with_label(edges, "a", moves, "x"), "b", moves, "y").select(
            F.col("x").alias("a"), F.col("y").alias("b")
        )
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels


def with_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, rows, component): every node with the smallest doc_id of its component."""
    named = stored(with_label(nodes.select("node", "rows", "smallest"), "node", labels, "label"))
    smallest = named.groupBy("label").agg(
        F.min("smallest").alias("component"), F.count(F.lit(1)).alias("rows"))
    found = map_side_join(named.select("label", "node", F.col("rows").alias("copies")),
                          stored(smallest), "label")
    return stored(found.select("node", F.col("copies").alias("rows"), "component"))


def near_components(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, carry...) of every document."""
    docs = marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry))
    rows = stored(describe(docs, (*carry, MARK)))
    nodes = stored(distinct_nodes(rows))
    members = nodes.select("node", F.posexplode("bands").alias("slot", "band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(members.join(shared.select("band"), "band"))
    meeting = nodes.select("node", "holder").join(members.select("node").distinct(), "node")
    sets = stored(node_sets(docs, meeting))
    labels = contract(confirm(stored(first_links(members)), nodes, sets))
    opened = stored(open_members(members, labels))
    chosen = stored(involved(block_pairs(opened), nodes))
    labels = contract(forest(chosen, nodes, sets), labels)
    placed = with_components(nodes, labels)
    joined = map_side_join(rows.select("doc_id", "n_shingles", "node", *carry), placed, "node")
    empty = rows.filter("node IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component"), *carry)
    found = joined.select(empty.columns).unionByName(empty)
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), *carry,
    )


def near_duplicates_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents"))
