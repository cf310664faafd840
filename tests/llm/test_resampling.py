"""Importance resampling against a plain computation over strings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, rank string, weight int, score int, n int, bucket int"


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1)
                   for i in range(len(words) - n + 1)]


def brute(rows, target, buckets, longest, least, per_cent):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    found = [(key, *features(text, longest)) for key, text in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, able = [], []
    for key, words, fs in found:
        gained = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all)))
                  for b in map(bucket, fs)]
        weight = math.floor(sum(gained) / len(gained)) if gained else 0
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if len(words) >= least:
                able.append((-score, key))
        out.append((key, len(fs), weight, score))
    able.sort()
    ranks = {}
    for place, (_, key) in enumerate(able[: per_cent * len(able) // 100], 1):
        ranks.setdefault(key, []).append(place)
    whole = []
    for row in out:
        places = ranks.get(row[0], [])
        whole.append((*row, places.pop(0) if places else None))
    return sorted(whole, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = [f"Word{i}" for i in range(40)] + ["éa", "日本", "x y", "a-b", "Z9", "\x85", "[K]"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "   \n-- "), (203, "tie " * 30), (204, "tie " * 30),
             (None, "Word1 " * 25), (None, None), (205, "LONG word " * 60_000)]
    return [*rows, rows[7], rows[7]]


@pytest.mark.parametrize(("buckets", "longest", "least", "per_cent"),
                         [(10_000, 1, 20, 10), (97, 3, 5, 50), (8, 2, 0, 100), (50, 1, 20, 0)])
def test_resample(spark, rows, buckets, longest, least, per_cent):
    target = ["Word3 word4 A-B", None, "", "日本 word3 word5 " * 9]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    df = resampling.resample(docs, goal, buckets, longest, least, per_cent)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(row) for row in df.collect()), key=repr)
    assert got == brute(rows, target, buckets, longest, least, per_cent)


def test_ties_at_the_last_place(spark):
    """Equal scores: the smaller doc_id is drawn."""
    rows = [(i, 25, 25, 0, 7) for i in range(40)] + [(99, 25, 25, 0, 8), (98, 3, 3, 0, 50)]
    scored = spark.createDataFrame(
        rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    drawn = {r.doc_id: r["rank"] for r in resampling.draw(scored, 20, 10).collect() if r["rank"]}
    assert drawn == {99: 1, 0: 2, 1: 3, 2: 4}


def test_empty(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    alone = resampling.resample(docs, none).collect()
    assert sorted((tuple(r) for r in alone), key=repr) == brute(rows, [], 10_000, 1, 20, 10)


@pytest.mark.parametrize("size", [1, 5, 17, 1000])
def test_pieces_change_nothing(size):
    text = "Ab, c9 é-日本 x  " * 20
    for longest in (1, 2, 4):
        whole = Counter(v for part in resampling.grams(text, longest, 1 << 20) for v in part)
        cut = Counter(v for part in resampling.grams(text, longest, size) for v in part)
        assert cut == whole == Counter(
            zlib.crc32(f.encode()) for f in features(text, longest)[1])
