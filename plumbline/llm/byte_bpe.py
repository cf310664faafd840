"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one resolves a whole pre-token by a minimal perfect hash over the vocabulary: one seed
per bucket, one slot per entry, the entry's bytes to confirm. Tier two merges the bytes of a
miss: a heap holds candidate pairs by (rank, place), the bytes are a doubly linked list, and
stale pairs are skipped. The hash has a fixed size (one vocabulary) and is broadcast.

Defined cases: a null or empty text has no tokens; a pre-token of any length is merged whole;
repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.chunks import ChunkMemory
from plumbline.llm.common import map_texts, table

RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_MASK = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@dataclass(frozen=True)
class PerfectHash:
    """Keys to ids: slot = mix(hash, seed of the hash's bucket); as many slots as keys."""

    seeds: list[int]
    keys: list[bytes]
    ids: list[int]

    @staticmethod
    def build(entries: dict[bytes, int]) -> PerfectHash:
        n = len(entries)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(max(n // 3, 1))]
        for key in entries:
            number = xxhash.xxh3_64_intdigest(key)
            buckets[(number >> 32) % len(buckets)].append((number & _MASK, key))
        keys: list[bytes | None] = [None] * n
        seeds, free = [0] * len(buckets), n - 1
        for place in sorted(range(len(buckets)), key=lambda i: -len(buckets[i])):
            bucket = buckets[place]
            if len(bucket) > 1:
                seed = 1
                while True:
                    slots = [_slot(number, seed, n) for number, _ in bucket]
                    if len(set(slots)) == len(slots) and all(keys[s] is None for s in slots):
                        break
                    seed += 1
                seeds[place] = seed
                for slot, (_, key) in zip(slots, bucket, strict=True):
                    keys[slot] = key
            elif bucket:  # a single key takes any free slot, kept as a negative seed
                while keys[free] is not None:
                    free -= 1
                keys[free], seeds[place] = bucket[0][1], -free - 1
        return PerfectHash(seeds, keys, [entries[key] for key in keys])

    def get(self, key: bytes) -> int | None:
        number = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[(number >> 32) % len(self.seeds)]
        slot = -seed - 1 if seed < 0 else _slot(number & _MASK, seed, len(self.keys))
        return self.ids[slot] if self.keys[slot] == key else None


def _slot(number: int, seed: int, n: int) -> int:
    mixed = (number ^ (seed * 0x9E3779B1)) * 0x85EBCA6B & 0xFFFFFFFFFFFF
    return (mixed ^ (mixed >> 17)) % n


def merge_bytes(word: bytes, rank_of) -> list[int]:
    """Ids of a word: the pair of lowest rank merges first, the leftmost on ties."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into another
    before = list(range(-1, n - 1))
    heap = []

    def offer(left: int) -> None:
        right = end[left]
        if right < n:
            rank = rank_of(word[left : end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, right, end[right]))

    for place in range(n - 1):
        offer(place)
    while heap:
        _, left, right, past = heapq.heappop(heap)
        if end[left] != right or end[right] != past:
            continue
        end[left], end[right] = past, 0
        if past < n:
            before[past] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    ids, place = [], 0
    while place < n:
        rank = rank_of(word[place : end[place]])
        if rank is None:
            raise ValueError(f"byte {word[place]} is not in the vocabulary")
        ids.append(rank)
        place = end[place]
    return ids


class Codec:
    """Encoder and decoder over one perfect hash; what they remember is bounded."""

    def __init__(self, hashed: PerfectHash, pattern: str = public_tokenizers.PATTERN):
        self.hashed, self.split = hashed, regex.compile(pattern).findall
        self.token = [b""] * (max(hashed.ids, default=-1) + 1)
        for key, number in zip(hashed.keys, hashed.ids, strict=True):
            self.token[number] = key
        self.ranks: dict[bytes, int | None] = {}
        self.words: dict[str, bytes] = {}
        self.memory = ChunkMemory(self._chunk, room=400_000)

    def rank_of(self, part: bytes) -> int | None:
        rank = self.ranks.get(part, -1)
        if rank == -1:
            rank = self.hashed.get(part)
            if len(part) <= 16:
                if len(self.ranks) > 300_000:
                    self.ranks.clear()
                self.ranks[part] = rank
        return rank

    def _word(self, text: str) -> bytes:
        found = self.words.get(text)
        if found is None:
            word = text.encode()
            whole = self.hashed.get(word)
            ids = merge_bytes(word, self.rank_of) if whole is None else [whole]
            found = np.array(ids, dtype="<u4").tobytes()
            if len(self.words) > 600_000:
                self.words.clear()
            self.words[text] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.memory.code(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: The codec of this worker process by the vocabulary's digest; it stays warm between tasks.
_CODECS: dict[str, Codec] = {}


def _worker_codec(digest: str, shared) -> Codec:
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(shared.value)
    return _CODECS[digest]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    ranks = read_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash.build(ranks))

    def make():
        codec = _worker_codec(digest, shared)

        def run(keys, texts):
            ids = list(map(codec.encode, texts))
            return {
                "doc_id": keys,
                "n_tokens": [len(code) // 4 for code in ids],
                "ids_sha256": [hashlib.sha256(code).hexdigest() for code in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(c)).hexdigest() for c in ids],
            }

        return run

    return map_texts(docs, make, SCHEMA)


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), public_tokenizers.path(RANKS))
