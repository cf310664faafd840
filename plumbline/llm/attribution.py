"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Token spans (in bytes, from token lengths) are joined to
the spans of its sections by binary search; both are in order, so nothing is compared twice.

Rule for tokens that cross a boundary: a token belongs to the first section that holds any of
its bytes. Tokens outside all sections are counted under section -1, so the counts of a
document sum up to its tokens.

Defined cases: a null or empty text has one empty line and no tokens; sections must be in
order and must not overlap, and an empty one gets no tokens; repeated rows are counted each.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.chunks import ChunkMemory
from plumbline.llm.common import map_batches, slices, table

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id bigint, section bigint, first bigint, past bigint, n_tokens bigint"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones for
    themselves, the others in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(byte if byte in shown else next(rest)): byte for byte in range(256)}


@functools.cache
def encoder(path: str):
    """The vocabulary of a ``tokenizers`` file in an encoder of the same ids.

    ``tiktoken`` merges the same pairs several times faster; a test holds the ids of both
    libraries against each other. Strings of special tokens are ordinary text. A Python worker
    builds it once, for all of its tasks.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    special = {token["content"] for token in loaded["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {
        bytes(alphabet[c] for c in token): number
        for token, number in loaded["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def token_sizes(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to the sizes of its tokens in bytes."""
    loaded = encoder(path)
    numbers = range(loaded.max_token_value + 1)
    size = np.array([len(loaded.decode_single_token_bytes(i)) for i in numbers], np.uint16)
    memory = ChunkMemory(lambda chunk: size[loaded.encode_ordinary(chunk)].tobytes())
    return lambda text: np.frombuffer(memory.code(text), dtype=np.uint16)


def attribute(
    sizes: np.ndarray, first: np.ndarray, past: np.ndarray
) -> tuple[np.ndarray, int]:
    """Tokens per section [first, past) in bytes, and tokens outside all sections."""
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    real = np.flatnonzero(past > first)
    if not len(real):
        return np.zeros(len(first), dtype=np.int64), len(ends)
    # The first section that ends after the token's start holds a byte of it, or none does.
    at = np.searchsorted(past[real], starts, side="right")
    inside = at < len(real)
    inside[inside] = first[real][at[inside]] < ends[inside]
    counts = np.zeros(len(first), dtype=np.int64)
    counts[real] = np.bincount(at[inside], minlength=len(real))
    return counts, int(len(ends) - inside.sum())


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as sections, in characters, without their line breaks."""
    sizes = np.array([len(line) for line in text.split("\n")], dtype=np.int64)
    past = np.cumsum(sizes + 1) - 1
    return past - sizes, past


def byte_places(text: str) -> tuple[np.ndarray, int]:
    """The byte at which each character starts, and one past the last."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)), len(raw)


def token_counts(docs: DataFrame, path: str, sections: str | None = None) -> DataFrame:
    """(doc_id, section, first, past, n_tokens), sections in characters.

    ``sections`` names a column array<struct<first, past>>; without it lines are the sections.
    """

    def make():
        sizes_of = token_sizes(path)

        def spans(text, given):
            if sections is None:
                return lines_of(text)
            pairs = [(s["first"], s["past"]) for s in given or []]
            both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            return both[:, 0], both[:, 1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for part in slices(batch, "text"):
                    out = {name: [] for name in ("doc_id", "section", "first", "past", "n_tokens")}
                    given = part.column(2).to_pylist() if sections else [None] * len(part)
                    keys = part.column("doc_id").to_pylist()
                    for key, text, own in zip(keys, part.column("text").to_pylist(), given,
                                              strict=True):
                        text = text or ""
                        first, past = spans(text, own)
                        place, _ = byte_places(text)
                        limit = len(place) - 1
                        counts, outside = attribute(
                            sizes_of(text),
                            place[np.clip(first, 0, limit)], place[np.clip(past, 0, limit)],
                        )
                        out["doc_id"] += [key] * (len(first) + 1)
                        out["section"] += [*range(len(first)), -1]
                        out["first"] += [*first.tolist(), None]
                        out["past"] += [*past.tolist(), None]
                        out["n_tokens"] += [*counts.tolist(), outside]
                    yield out

        return run

    columns = ["doc_id", "text"] + ([sections] if sections else [])
    return map_batches(docs.select(*columns), make, SCHEMA)


def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)
    )
