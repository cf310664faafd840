"""Fill-in-middle by a piece table.

A document is a list of descriptors (buffer, start, stop) over two buffers that never change:
the UTF-8 bytes of its text and the sentinels. Cutting splits the text's descriptor in three, an
arrangement permutes them behind their sentinels, and the output is one pass over the
descriptors. Restoring builds the descriptors of an output from the places of its sentinels and
permutes them back. Digests stream over descriptors, so neither needs a second copy of a text.

Defined cases: a null text is empty and stays plain; so does a text that contains a sentinel; a
row without doc_id draws as one with an empty id; repeated rows are treated alike; tokens of
long texts are counted in pieces; an empty table gives no rows. Other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, map_texts, slices, table

#: Contract: seed, per cent of documents left plain (from this on), per cent of suffix first.
SEED, PLAIN_FROM, SUFFIX_FIRST = "1", 90, 20
#: One buffer of sentinels, and where each part's sentinel lies in it.
SENTINELS = b"<P><S><M>"
MARKS = {"prefix": (0, 3), "suffix": (3, 6), "middle": (6, 9)}
#: The parts of a document in their order in the text, and in the output of each form.
PARTS = ("prefix", "middle", "suffix")
ARRANGEMENTS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Bytes whose tokens are found at a time.
PIECE = 1 << 20

TEXT, MARK = 0, 1
Piece = tuple[int, int, int]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def token_starts(raw: bytes, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, starts in the piece) of the tokens ``[A-Za-z]+|[^A-Za-z]``, piece by piece.

    A token starts at a letter that follows no letter, and at every first byte of another
    character.
    """
    whole = np.frombuffer(raw, dtype=np.uint8)
    before = False
    for at in range(0, len(whole), size):
        part = whole[at : at + size]
        letter = _LETTER[part]
        starts = (part & 0xC0) != 0x80
        starts[1:] &= ~(letter[1:] & letter[:-1])
        starts[0] &= not (before and letter[0])
        before = bool(letter[-1])
        yield at, np.flatnonzero(starts)


def count_tokens(raw: bytes, size: int = PIECE) -> int:
    return sum(len(starts) for _, starts in token_starts(raw, size))


def token_offsets(raw: bytes, wanted: list[int], size: int = PIECE) -> list[int]:
    """Byte offsets at which the wanted tokens start; past the last token, the end."""
    found = [len(raw)] * len(wanted)
    seen = 0
    for at, starts in token_starts(raw, size):
        for i, number in enumerate(wanted):
            if seen <= number < seen + len(starts):
                found[i] = at + int(starts[number - seen])
        seen += len(starts)
    return found


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(raw: bytes, first: int, second: int) -> dict[str, Piece]:
    """The one descriptor of a text split before its tokens ``first`` and ``second``."""
    low, high = token_offsets(raw, [first, second])
    edges = [0, low, high, len(raw)]
    return {part: (TEXT, *edges[i : i + 2]) for i, part in enumerate(PARTS)}


def arrange(parts: dict[str, Piece], form: str) -> list[Piece]:
    """Descriptors of the output: every part behind its sentinel, in the order of the form."""
    out: list[Piece] = []
    for part in ARRANGEMENTS[form]:
        out += [(MARK, *MARKS[part]), parts[part]]
    return out


def read_back(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that give the text again: the inverse permutation."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    edges = []
    at = 0
    for part in ARRANGEMENTS[form]:
        mark = SENTINELS[slice(*MARKS[part])]
        at = output.index(mark, at)
        edges.append((at, at + len(mark)))
        at += len(mark)
    stops = [start for start, _ in edges[1:]] + [len(output)]
    found = {
        part: (TEXT, start, stop)
        for part, (_, start), stop in zip(ARRANGEMENTS[form], edges, stops, strict=True)
    }
    return [found[part] for part in PARTS]


def spans(pieces: list[Piece], raw: bytes) -> Iterator[memoryview]:
    buffers = memoryview(raw), memoryview(SENTINELS)
    for buffer, start, stop in pieces:
        yield buffers[buffer][start:stop]


def digest(pieces: list[Piece], raw: bytes) -> str:
    state = hashlib.sha256()
    for span in spans(pieces, raw):
        state.update(span)
    return state.hexdigest()


def characters(raw: bytes, piece: Piece, size: int = PIECE) -> int:
    """Code points of a piece of the text."""
    _, start, stop = piece
    part = np.frombuffer(raw, dtype=np.uint8)[start:stop]
    return sum(
        int(((part[at : at + size] & 0xC0) != 0x80).sum()) for at in range(0, len(part), size)
    )


def transform(doc_id: int | None, text: str, seed: str = SEED) -> dict:
    """The row of one document: tokens, form, sizes, descriptors and output."""
    raw = text.encode()
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = count_tokens(raw)
    marked = any(SENTINELS[slice(*place)] in raw for place in MARKS.values())
    if not raw or marked or h3 % 100 >= PLAIN_FROM:
        pieces, form, sizes = [(TEXT, 0, len(raw))], "plain", (None, None)
    else:
        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        parts = cut(raw, *sorted((h1 % (n + 1), h2 % (n + 1))))
        pieces = arrange(parts, form)
        sizes = tuple(characters(raw, parts[part]) for part in ("prefix", "middle"))
    return {
        "doc_id": doc_id, "n": n, "form": form, "prefix_chars": sizes[0],
        "middle_chars": sizes[1], "pieces": pieces, "output": b"".join(spans(pieces, raw)),
    }


_PIECES = "array<struct<buffer: int, start: bigint, stop: bigint>>"
_HEAD = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"


def fill_in_middle(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, pieces, output) of every document.

    ``output`` is UTF-8; ``pieces`` are its descriptors (buffer 0: the text, 1: SENTINELS) in
    bytes.
    """

    def make() -> Callable:
        def run(keys: list, texts: list[str]) -> dict:
            rows = [transform(key, text, seed) for key, text in zip(keys, texts, strict=True)]
            out = {name: [row[name] for row in rows] for name in rows[0]}
            out["pieces"] = [
                [dict(zip(("buffer", "start", "stop"), piece, strict=True)) for piece in pieces]
                for pieces in out["pieces"]
            ]
            return out

        return run

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(keyed, make, f"{_HEAD}, pieces {_PIECES}, output binary")


def restore(formed: DataFrame) -> DataFrame:
    """(doc_id, text) read back from the outputs and forms alone."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                forms, outputs = (batch.column(n).to_pylist() for n in ("form", "output"))
                texts = [
                    b"".join(spans(read_back(output, form), output)).decode()
                    for form, output in zip(forms, outputs, strict=True)
                ]
                yield {"doc_id": batch.column("doc_id"), "text": texts}

        return run

    return map_batches(
        formed.select("doc_id", "form", "output"), make, "doc_id bigint, text string"
    )


def with_digests(formed: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with the digests of output and restored text."""
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for part in slices(batch, "output"):
                    forms, outputs = (part.column(n).to_pylist() for n in ("form", "output"))
                    yield {name: part.column(name) for name in names} | {
                        "output_sha256": [hashlib.sha256(output).hexdigest() for output in outputs],
                        "restored_sha256": [
                            digest(read_back(output, form), output)
                            for form, output in zip(forms, outputs, strict=True)
                        ],
                    }

        return run

    return map_batches(
        formed.select(*names, "output"), make,
        f"{_HEAD}, output_sha256 string, restored_sha256 string",
    )


def fill_in_middle_query(spark: SparkSession, folder: str) -> DataFrame:
    return with_digests(fill_in_middle(table(spark, folder, "documents")))


FILL_IN_MIDDLE_SQL = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
  sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(tokens) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
  ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
  ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
parts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low,
  greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
texts AS (SELECT *, array_to_string(tokens[1:low], '') AS prefix,
  array_to_string(tokens[low + 1:high], '') AS middle,
  array_to_string(tokens[high + 1:], '') AS suffix FROM parts)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM texts
"""
