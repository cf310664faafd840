"""Exact dedup against grouping by hand; Misra-Gries against exact counts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import exact

SCHEMA = "doc_id bigint, text string, row int, digest string, size int, best int, kept int"


def brute(rows, normalise=lambda text: text):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normalise(text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        stays = 0
        for i in ids:
            kept = i == best and not stays
            stays += kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """A third of all rows in one group, groups of every size below, single rows, odd rows."""
    rng = random.Random(3)
    texts = ["hot"] * 400 + [f"g{i}" for i in range(30) for _ in range(i)]
    texts += [f"single {i}" for i in range(300)] + ["", None, None, " ", "é", "é", "w" * 500_000]
    rng.shuffle(texts)
    out = list(enumerate(texts))
    out += [out[5], out[5], (None, "hot"), (None, "only without id"), (None, "only without id")]
    return out


@pytest.mark.parametrize("heavy", [2, 16, exact.HEAVY])
def test_copies(spark, rows, heavy):
    docs = spark.createDataFrame([(*row, 1, "x", 2, 3, 4) for row in rows], SCHEMA).repartition(7)
    df = exact.exact_copies(docs, heavy=heavy)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(df) == brute(rows)


def test_normaliser(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a c"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(exact.exact_copies(docs, F.lower)) == brute(rows, str.lower)


def test_empty(spark):
    assert exact.exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_split_is_bounded(spark, rows):
    """Winners are the heavy groups and no others; the rest holds no heavy group."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    digests = exact.stored(exact.digests(docs))
    sizes = Counter(text or "" for _, text in rows)
    for heavy in (2, 3, 20, 60):
        winners = exact.heavy_winners(digests, len(rows), heavy).collect()
        wanted = {hashlib.sha256(t.encode()).digest(): n for t, n in sizes.items()
                  if n > 1 and n * heavy >= len(rows)}
        assert {bytes(w.digest): w["size"] for w in winners} == wanted
        assert exact.heavy_candidates(digests, len(rows), heavy).count() <= 2 * heavy


def test_heavy_rows_are_not_shuffled(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = exact.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the rest by digest
    assert "text" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=40), max_size=8), st.integers(1, 6))
def test_misra_gries(batches, room):
    summary = exact.Frequent(room)
    for batch in batches:
        summary.add(batch)
    true = Counter(item for batch in batches for item in batch)
    assert len(summary.counters) <= room
    for item, n in true.items():
        assert n - summary.items / (room + 1) <= summary.counters[item] <= n
