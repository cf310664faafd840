"""Fill-in-middle against string slices, restored from the outputs."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import middles

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id bigint, text string, form int, n string, pieces int, output int"


def brute(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(p) for p in (tokens[:low], tokens[low:high], tokens[high:])]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    prefix, middle, suffix = parts
    if h[3] % 100 < 20:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (key, n, form, len(prefix), len(middle), output)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    alphabet = "ab Z\n<>PSM é日\U0001f600́\x85 9"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(300)]
    texts += [None, "", "a", "é", "<P>", "x <M> y", "<<S", "<P" * 9, "Long wörd " * 150_000]
    rows = list(enumerate(texts))
    return [*rows, (None, "no id"), (None, None), rows[4], rows[4], (-7, "below zero é 9")]


def test_forms(spark, rows):
    docs = spark.createDataFrame([(*row, 1, "x", 2, 3) for row in rows], SCHEMA).repartition(4)
    formed = middles.fill_in_middle(docs)
    got = sorted(
        ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode())
         for r in formed.collect()), key=repr)
    wanted = sorted((brute(*row) for row in rows), key=repr)
    assert got == wanted
    assert {row[2] for row in wanted} == {"plain", "psm", "spm"}
    texts = sorted(((r.doc_id, r.text) for r in middles.restore(formed).collect()), key=repr)
    assert texts == sorted(((key, text or "") for key, text in rows), key=repr)
    digests = sorted((tuple(r) for r in middles.with_digests(formed).collect()), key=repr)

    def hashed(text):
        return hashlib.sha256((text or "").encode()).hexdigest()

    assert digests == sorted(
        ((*brute(*row)[:5], hashed(brute(*row)[5]), hashed(row[1])) for row in rows), key=repr)


def test_descriptors_cover_the_text(spark, rows):
    """Text descriptors are disjoint and cover every byte of the text once."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [(key, len((text or "").encode())) for key, text in rows]
    got = []
    for row in middles.fill_in_middle(docs).collect():
        at = 0
        for piece in sorted((p for p in row.pieces if p.buffer == middles.TEXT),
                            key=lambda p: (p.start, p.stop)):
            assert piece.start == at
            at = piece.stop
        got.append((row.doc_id, at))
    assert sorted(got, key=repr) == sorted(sizes, key=repr)


def test_empty(spark):
    assert middles.with_digests(middles.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZ é日<9\n", max_size=40), st.integers(1, 9))
def test_tokens_in_pieces(text, size):
    raw, tokens = text.encode(), TOKEN.findall(text)
    assert middles.count_tokens(raw, size) == len(tokens)
    edges = [len("".join(tokens[:i]).encode()) for i in range(len(tokens) + 1)]
    assert middles.token_offsets(raw, list(range(len(tokens) + 1)), size) == edges
    assert middles.characters(raw, (0, 0, len(raw)), size) == len(text)
