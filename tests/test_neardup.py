"""Near duplicates against brute force, with clusters that hold a third of the texts."""

from __future__ import annotations

import random
import re

import pytest

from plumbline.operators import neardup


def words(text):
    skeleton = re.sub(r"\d+(?:\.\d+)?", "#", text.lower())
    return set(re.sub(r"[^a-z#]+", " ", skeleton).split())


def similar(a, b, t=0.85):
    a, b = words(a), words(b)
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= t


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    template = rng.sample(vocabulary, 30)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            body = template[:]  # exact copies
        elif kind in (1, 2):
            body = template[:]
            for _ in range(rng.randrange(1, 4)):  # near copies around the threshold
                body[rng.randrange(len(body))] = rng.choice(vocabulary)
        elif kind == 3:
            body = rng.sample(vocabulary[:12], rng.randrange(1, 9))  # short, few words
        else:
            body = rng.sample(vocabulary, rng.randrange(5, 40))
        rng.shuffle(body)
        texts.append((f"t{i:03d}", i, " ".join(body)))
    texts += [("x1", n, ""), ("x2", n + 1, "12 34"), ("x3", n + 2, "!!!")]
    return texts


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 5), (3, 2)])
def test_near_duplicates_equal_brute_force(spark, seed, block):
    texts = corpus(seed)
    df = spark.createDataFrame(texts, "id string, n int, text string").repartition(5)
    got = {
        r.id: r.is_duplicate
        for r in neardup.near_duplicates(df, "n", block=block).collect()
    }
    expected = {
        i: any(similar(text, earlier) for _, m, earlier in texts if m < n) for i, n, text in texts
    }
    assert got == expected
    assert 0 < sum(expected.values()) < len(texts)


def test_pairs_equal_brute_force(spark):
    texts = corpus(4, 60)
    df = spark.createDataFrame(texts, "id string, n int, text string")
    got = {(r.id, r.other) for r in neardup.similar_pairs(df.select("id", "text")).collect()}
    expected = {
        (a, b) for a, _, x in texts for b, _, y in texts if a < b and similar(x, y)
    }
    assert got == expected


def chained(n):
    """Texts that are each similar to the two before only, and share one rare word with all."""
    return [
        (f"c{i:04d}", i, " ".join(["rareword", *(f"x{chr(97 + j // 26)}{chr(97 + j % 26)}"
                                                for j in range(i, i + 24))]))
        for i in range(n)
    ]


def test_hot_word_is_split(spark):
    """Every set has the same prefix word: blocks stay bounded and the output linear."""
    texts = chained(300)
    df = spark.createDataFrame(texts, "id string, n int, text string").repartition(6)
    sets = neardup.stored(neardup.numbered_sets(neardup.keyed_words(df, "n")))
    ranked = neardup.stored(neardup.ranked_sets(sets, neardup.stored(neardup.word_order(sets))))
    members = neardup.stored(neardup.prefixes(ranked, 0.85)).select(
        neardup.F.lit(7).cast("bigint").alias("token"), "set", "n", "m", "place", "bins"
    ).dropDuplicates(["set"])
    seekers = members.select("set").distinct()
    block = 20
    dealt = neardup.stored(neardup.block_pairs(members, seekers, block))
    sizes = [r["count"] for r in dealt.groupBy(*neardup.GROUP).count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 4 * block
    named = neardup._alike_pairs(neardup.block_pairs(members, seekers, block), 0.85)
    assert named.count() <= members.count() * -(-members.count() // block)
    got = {r.id for r in neardup.near_duplicates(df, "n", block=block).collect() if r.is_duplicate}
    assert got == {
        i for i, n, text in texts if any(similar(text, e) for _, m, e in texts if m < n)
    }


def test_word_by_word_blocks_agree_with_the_rounds(spark):
    """The last step alone, with every set open, finds what all steps find."""
    texts = corpus(5, 120)
    df = spark.createDataFrame(texts, "id string, n int, text string").repartition(3)
    sets = neardup.stored(neardup.numbered_sets(neardup.keyed_words(df, "n").filter("size(words) > 0")))
    ranked = neardup.stored(neardup.ranked_sets(sets, neardup.stored(neardup.word_order(sets))))
    members = neardup.stored(neardup.prefixes(ranked, 0.85))
    everyone = neardup.stored(members.select("set").distinct())
    found = neardup._found_in_blocks(
        neardup.block_pairs(members, everyone, 7), ranked, 0.85)
    got = {r["set"] for r in found.collect()}
    late = neardup.later_sets(ranked, 0.85, 7)
    assert got == {r["set"] for r in late.collect()} and got


def test_bounds_never_exclude_similar_sets(spark):
    """Sizes, places and bins against true Jaccard of random sets."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10_000, 400, replace=False))
    for _ in range(300):
        size = int(rng.integers(5, 400))
        a = np.sort(rng.choice(base, size, replace=False))
        b = a.copy()
        for _ in range(int(rng.integers(0, size // 4 + 1))):
            b[rng.integers(len(b))] = rng.integers(10_000)
        b = np.unique(b)
        both = np.intersect1d(a, b)
        if not len(both) or len(both) / (len(a) + len(b) - len(both)) < 0.85:
            continue
        facts = neardup.Members(pa.RecordBatch.from_pydict({
            "n": [len(a), len(b)], "m": [len(a), len(b)],
            "place": [int(np.searchsorted(s, both[0])) for s in (a, b)],
            "bins": [neardup._bins(s, np.zeros(len(s), dtype=int), 1)[0].tobytes()
                     for s in (a, b)],
        }))
        one, two = np.array([0]), np.array([1])
        assert neardup.can_match(facts, one, facts, two, 0.85).all()


def test_similar_sets_agree_on_a_part():
    """Sets at and near the threshold, of sizes on both sides of the bounds of size classes."""
    import numpy as np

    rng = np.random.default_rng(3)
    for threshold in (0.85, 0.5):
        met = 0
        for _ in range(1500):
            size = int(rng.integers(1, 120))
            a = rng.choice(1 << 40, size, replace=False)
            lost = int(rng.integers(0, size))
            added = rng.choice(1 << 40, int(rng.integers(0, size // 2 + 1))) + (1 << 41)
            b = np.append(a[lost:], added)
            shared = len(np.intersect1d(a, b))
            alike = shared / (len(a) + len(b) - shared) >= threshold
            n = np.array([len(a), len(b)])
            keys, held = neardup._part_keys(n, np.append(a, rng.permutation(b)), n, threshold)
            if alike:
                assert set(keys[: held[0]]) & set(keys[held[0] :])
            met += alike
        assert met > 50


def test_bits_of_long_and_short_sets_never_exclude_similar_ones():
    """Sets on both sides of a doubling of the bits; unlike sets of many words are told apart."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)

    def members(*sets):
        n = np.array([len(s) for s in sets])
        return neardup.Members(pa.RecordBatch.from_pydict({
            "n": n, "m": n, "place": np.zeros(len(n), dtype=int),
            "bins": neardup._packed_bins(n, np.concatenate(sets), n),
        }))

    one, two, three = (np.array([i]) for i in range(3))
    for size in (500, 512, 513, 1000, 1025, 4090):
        a = rng.choice(1 << 40, size, replace=False)
        more = np.append(a, rng.choice(1 << 40, int(size * 0.17)) + (1 << 41))
        other = rng.choice(1 << 40, size, replace=False)
        facts = members(a, more, other)
        assert neardup.can_match(facts, one, facts, two, 0.85).all()
        assert neardup.can_match(facts, two, facts, one, 0.85).all()
        assert facts.apart(one, facts, two)[0] <= len(more) - len(a)
        assert not neardup.can_match(facts, one, facts, three, 0.85).any()


def test_few_words_in_many_texts_are_not_all_pairs(spark, monkeypatch):
    """Texts of one small vocabulary share every word with many others; few are compared."""
    rng = random.Random(6)
    vocabulary = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    texts = []
    for i in range(400):
        body = rng.sample(vocabulary, 60)
        if i % 40 == 39:  # a near copy of the one before
            body = [*texts[-1][2].split()[:57], *rng.sample(vocabulary, 3)]
        texts.append((f"s{i:03d}", i, " ".join(body)))
    df = spark.createDataFrame(texts, "id string, n int, text string").repartition(4)
    compared = []

    def counted(*args, deal=neardup.block_pairs):
        dealt = deal(*args)
        sizes = dealt.groupBy(*neardup.GROUP).count().collect()
        compared.append(sum(r["count"] * (r["count"] - 1) // 2 for r in sizes))
        return dealt

    monkeypatch.setattr(neardup, "block_pairs", counted)
    got = {r.id for r in neardup.near_duplicates(df, "n").collect() if r.is_duplicate}
    assert got == {
        i for i, n, text in texts if any(similar(text, e) for _, m, e in texts if m < n)
    }
    assert len(got) == 10
    assert sum(compared) < 2 * len(texts)


def test_parts_that_span_partitions_are_kept(spark):
    """Every key that two sets have comes back with all its sets, whatever the partitions."""
    rows = [(key, s) for key in range(60) for s in range(40 if key % 7 == 0 else 1 + key % 2)]
    keys = spark.createDataFrame(rows, "token bigint, set bigint").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        kept = [tuple(r) for r in neardup.met_keys(keys).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    held = {key: sum(k == key for k, _ in rows) for key, _ in rows}
    assert {r for r in rows if held[r[0]] > 1} <= set(kept)
    assert len(kept) < len(rows)
